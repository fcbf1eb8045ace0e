"""Undeclared charsets: the decoder against one that goes byte by byte, the last resort, and what wins over what."""

from hypothesis import given, settings
from hypothesis import strategies as st

from cueflow.sources.encoding import decode_gb18030, guess


def _char(data, codec):
    try:
        out = data.decode(codec)
    except UnicodeDecodeError:
        return None
    return out if len(out) == 1 else None


def _plain(data):
    out, at, four, doubtful = [], 0, False, 0
    while at < len(data):
        b, after = data[at], data[at + 1] if at + 1 < len(data) else 0
        if b <= 0x80:
            char, size = chr(b) if b < 0x80 else "\u20ac", 1
        elif 0x30 <= after <= 0x39:
            char, size, four = _char(data[at : at + 4], "gb18030"), 4, True
        else:
            char, size = _char(data[at : at + 2], "gbk"), 2
            doubtful += 0x81 <= b <= 0x9F or 0xE0 <= b <= 0xEF
        if char is None or at + size > len(data):
            return None, four, doubtful
        out.append(char)
        at += size
    return "".join(out), four, doubtful


_PIECES = st.sampled_from([b"a", b"\n", b"\x80", b"\xff", b"\x81\x30\x81\x30", b"\x95\x32\x82\x36", b"\xd6\xd0", b"\xce\xc4", b"\x81\x40", b"\xe0\xa1", b"\x81", b"\xfe\x39", b"\xa4\xa2"])


@given(st.one_of(st.binary(max_size=40), st.lists(_PIECES, max_size=12).map(b"".join)))
@settings(max_examples=2000, deadline=None)
def test_gb18030_byte_by_byte(data):
    got, want = decode_gb18030(data), _plain(data)
    assert got[0] == want[0]
    if got[0] is not None:
        assert got == want


def test_which_charset_wins():
    assert guess(b"A\x01\xe9") == ("A\x01\u00e9", "Windows-1252")  # a third of controls: the last resort only
    assert guess(b"\x01\x01\xe9") == (None, None)
    assert guess(bytes.fromhex("8FB0A1A4A2")) == ("\u4e02\u3042", "EUC-JP")
    assert guess("\u4e2d\u6587".encode("gbk")) == ("\u4e2d\u6587", "GBK")
    assert guess("\U00020000".encode("gb18030") * 3) == ("\U00020000" * 3, "GB18030")
    assert guess("caf\u00e9".encode("cp1252")) == ("caf\u00e9", "Windows-1252")


def test_a_long_text_is_no_loop_over_bytes():
    text = "\u4e2d\u6587, and ASCII. " * 200_000
    assert decode_gb18030(text.encode("gbk"))[0] == text
