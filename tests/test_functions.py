import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.functions import codecs, crypt, numeric, text
from folioforge.operators.content import inline_image, parse_ops, serialize_ops
from folioforge.operators.fonts import parse_cmap, write_cmap
from folioforge.sources.files import File
from folioforge.sources.syntax import Parser


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    for kind in ("ASCIIHexDecode", "ASCII85Decode", "LZWDecode", "FlateDecode"):
        assert codecs.decode(codecs.encode(data, kind), kind) == data
    late = {"EarlyChange": 0}
    assert codecs.lzw_decode(codecs.lzw_encode(data, late), late) == data
    for stride, bpp in ((7, 1), (9, 3), (8, 4)):
        assert codecs.predictor_rows(codecs.predictor_rows(data, stride, bpp, False, bytes(range(5))), stride, bpp, True) == data


def test_long_lzw():
    data = bytes(i * i % 251 for i in range(60_000))
    assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


def test_codec_values_and_errors():
    assert codecs.a85_encode(b"hello world!") == b"BOu!rD]j7BEbo80~>" and codecs.a85_decode(b"BOu!rD]j7BEbo80~>") == b"hello world!"
    assert codecs.rle_decode(bytes.fromhex("FE61FF6202636263FE6180")) == b"aaabbcbcaaa"
    assert codecs.hex_decode(b"61 6 >zz") == b"a"
    for f in (lambda: codecs.a85_decode(b"BOu!r"), lambda: codecs.rle_decode(b"\x05ab"), lambda: codecs.decode(b"", "JPXDecode"), lambda: codecs.flate_decode(b"nonsense"), lambda: codecs.flate_decode(codecs.flate_encode(bytes(1000)), limit=10)):
        with pytest.raises(codecs.CodecError):
            f()


def test_ciphers():
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    assert crypt.aes_cbc(key, bytes(range(16)), bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), True).hex() == "7649abac8119b246cee98e9b12e9197d"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for size in (16, 32):
        k, m = bytes(range(size)), bytes(range(64))
        assert crypt.aes_cbc(k, bytes(16), crypt.aes_cbc(k, bytes(16), m, True), False) == m


def sealed(password, size=16, revision=4):
    """The user entry and key of an RC4 file, by the published algorithm."""
    owner, file_id, p = b"owner pwd hash!!" * 2, b"\xde\xad\xbe\xef", -4
    k = hashlib.md5((password + crypt.PADDING)[:32] + owner + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
    for _ in range(50):
        k = hashlib.md5(k[:size]).digest()
    u = hashlib.md5(crypt.PADDING + file_id).digest()
    for i in range(20):
        u = crypt.rc4(bytes(b ^ i for b in k[:size]), u)
    return {"V": 4, "R": revision, "O": owner, "U": u + bytes(16), "P": p, "CF": {"StdCF": {"CFM": "V2"}}, "StmF": "StdCF", "Length": 128}, file_id


def test_passwords():
    d, file_id = sealed(b"secret")
    decoder = crypt.Decoder.open(d, file_id, b"secret")
    assert decoder.decrypt(5, 0, crypt.rc4(decoder.object_key(5, 0), b"plain")) == b"plain"
    with pytest.raises(crypt.CryptError, match="InvalidPassword"):
        crypt.Decoder.open(d, file_id, b"wrong")
    for revision, digest in ((5, lambda p, s: hashlib.sha256(p + s).digest()), (6, crypt.revision_6_hash)):
        key, salt = bytes(range(32)), b"12345678abcdefgh"
        u = digest(b"pw", salt[:8]) + salt
        hard = {"V": 5, "R": revision, "U": u, "O": bytes(48), "UE": crypt.aes_cbc(digest(b"pw", salt[8:]), bytes(16), key, True), "OE": bytes(32), "CF": {"S": {"CFM": "AESV3"}}, "StmF": "S"}
        decoder = crypt.Decoder.open(hard, b"", b"pw")
        assert decoder.key == key
        body = bytes(16) + crypt.aes_cbc(key, bytes(16), b"sixteen bytes ok" + bytes([16]) * 16, True)
        assert decoder.decrypt(1, 0, body) == b"sixteen bytes ok"


def test_encrypted_file_keeps_its_own_strings_plain():
    d, file_id = sealed(b"")
    body = b"%PDF-1.4\n"
    e = b"3 0 obj <</Filter/Standard/V 4/R 4/O<" + d["O"].hex().encode() + b">/U<" + d["U"].hex().encode() + b">/P -4/CF<</StdCF<</CFM/V2>>>>/StmF/StdCF/Length 128>> endobj\n"
    one = b"1 0 obj <</Type/Catalog>> endobj\n"
    key = crypt.Decoder.open(d, file_id, b"")
    two = b"2 0 obj <" + crypt.rc4(key.object_key(2, 0), b"hidden").hex().encode() + b"> endobj\n"
    at = [len(body), len(body + one), len(body + one + two)]
    data = body + one + two + e
    data += b"xref\n1 3\n" + b"".join(b"%010d 00000 n \n" % p for p in at) + b"trailer <</Size 4/Root 1 0 R/Encrypt 3 0 R/ID[<DEADBEEF><DEADBEEF>]>>\nstartxref\n%d\n%%%%EOF" % len(data)
    f = File.open(data)
    assert f.get(2) == b"hidden" and f.get(3)["O"][:16] == b"owner pwd hash!!"


def test_instructions():
    src = b"q 1 0 0 1 5 6 cm 0 0 m 1 2 3 4 v 1 2 3 4 y h S BT /F1 12 Tf 3 -4 TD (a) Tj T* (b) Tj 1 2 (c) \" [(x) -20 (y)] TJ ET /Sh1 sh BX zz EX zz 9 Tr 1 Tr Q"
    ops = parse_ops(src)
    assert [o[1] for o in ops if o[0] == "sh"] == ["Shade"] and [o[2] for o in ops if o[1] == "TextRenderMode"] == [[1.0]]
    assert [o[1:] for o in parse_ops(serialize_ops([o[1:] for o in ops]))] == [o[1:] for o in ops]
    data, (info,) = inline_image(Parser(b"/W 768 /H 150 /BPC 1 /IM true /F [/A85 /Fl] ID\nxyz~>\nEI"))
    assert data == b"xyz~>" and info == {"Width": 768, "Height": 150, "BitsPerComponent": 1, "ImageMask": True, "Filter": ["ASCII85Decode", "FlateDecode"]}


def test_character_maps():
    table = {1: "a", 2: "b", 3: "ß", 9: "𝄞", 200: "x"}
    assert parse_cmap(write_cmap(table)) == table
    assert parse_cmap(b"1 beginbfrange <00fe> <0101> <00fe> endbfrange endcmap") == {254: "þ", 255: "ÿ"}


def test_columns(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    x = lambda c: one.select(c.alias("v")).first().v
    d = x(text.parse_date(F.lit("D:199812231952-08'00")))
    assert (d.year, d.month, d.day, d.hour, d.minute, d.second, d.rel, d.tz_hour, d.tz_minute) == (1998, 12, 23, 19, 52, 0, "Earlier", 8, 0)
    assert x(text.parse_date(F.lit("1998"))) is None and x(text.parse_date(F.lit("D:1998xx"))).month == 1
    parts = [lambda c: numeric.exponential(c, 0.0, 1.0, 1), lambda c: numeric.exponential(c, 1.0, 2.0, 1)]
    stitched = [x(numeric.stitching(F.lit(v), (0.0, 1.0), [0.5], [(0.0, 1.0)] * 2, parts)) for v in (0.25, 0.75, 0.0, 1.0)]
    assert stitched == pytest.approx([0.5, 1.5, 0, 2])
    with pytest.raises(numeric.StackError):
        numeric.program("{ 100 0 roll }", [F.lit(1.0)], 1)
    assert x(text.lookup(F.lit("CCF"), text.VALUE_ABBREVIATIONS)) == "CCITTFaxDecode" and x(text.lookup(F.lit("d"), text.COUNTER_STYLES)) == "d"
