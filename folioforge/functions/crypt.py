"""Decryption of files: RC4 and AES, the standard password scheme, and column functions for per-object keys."""

from __future__ import annotations

import hashlib
import stringprep
import unicodedata
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fixed padding of passwords in the standard scheme.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class CryptError(ValueError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[bytes, bytes]:
    """The substitution box by its rule: inverse in the field, then the affine map; and its inverse."""
    inverse = [0] * 256
    for a in range(1, 256):
        if not inverse[a]:
            b = next(b for b in range(1, 256) if _times(a, b) == 1)
            inverse[a], inverse[b] = b, a
    turn = lambda x, n: (x << n | x >> (8 - n)) & 255
    box = bytes(x ^ turn(x, 1) ^ turn(x, 2) ^ turn(x, 3) ^ turn(x, 4) ^ 0x63 for x in inverse)
    return box, bytes(box.index(i) for i in range(256))


_BOX, _BACK = _boxes()
_MUL = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    n, words = len(key) // 4, [key[i : i + 4] for i in range(0, len(key), 4)]
    con = 1
    while len(words) < 4 * (n + 7):
        t = words[-1]
        if len(words) % n == 0:
            t = bytes(_BOX[b] for b in t[1:] + t[:1])
            t, con = bytes([t[0] ^ con]) + t[1:], _times(con, 2)
        elif n > 6 and len(words) % n == 4:
            t = bytes(_BOX[b] for b in t)
        words.append(bytes(a ^ b for a, b in zip(words[-n], t)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b))


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[0])
    for r, key in enumerate(keys[1:], 1):
        s = bytes(_BOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
        if r < len(keys) - 1:
            m2, m3 = _MUL[2], _MUL[3]
            s = b"".join(bytes(m2[c[k]] ^ m3[c[(k + 1) % 4]] ^ c[(k + 2) % 4] ^ c[(k + 3) % 4] for k in range(4)) for c in (s[i : i + 4] for i in range(0, 16, 4)))
        s = _xor(s, key)
    return s


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[-1])
    for r, key in enumerate(keys[-2::-1]):
        s = bytes(_BACK[s[(i - 4 * (i % 4)) % 16]] for i in range(16))
        s = _xor(s, key)
        if r < len(keys) - 2:
            m9, mb, md, me = _MUL[9], _MUL[11], _MUL[13], _MUL[14]
            s = b"".join(bytes(me[c[k]] ^ mb[c[(k + 1) % 4]] ^ md[c[(k + 2) % 4]] ^ m9[c[(k + 3) % 4]] for k in range(4)) for c in (s[i : i + 4] for i in range(0, 16, 4)))
    return s


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes:
    """CBC without padding."""
    if len(data) % 16:
        raise CryptError("DecryptionFailure", "no whole blocks")
    keys, out, last = _round_keys(key), [], iv
    for i in range(0, len(data), 16):
        block = data[i : i + 16]
        if encrypt:
            last = _encrypt_block(keys, _xor(block, last))
            out.append(last)
        else:
            out.append(_xor(_decrypt_block(keys, block), last))
            last = block
    return b"".join(out)


def unpadded(data: bytes) -> bytes:
    n = data[-1] if data else 0
    if not 1 <= n <= 16 or data[-n:] != bytes([n]) * n:
        raise CryptError("DecryptionFailure", "padding")
    return data[:-n]


def revision_6_hash(password: bytes, salt: bytes, owner: bytes = b"") -> bytes:
    """The hardened hash: at least 64 rounds of AES-128-CBC over 64 copies, each choosing the next hash function."""
    k, i = hashlib.sha256(password + salt + owner).digest(), 0
    while True:
        e = aes_cbc(k[:16], k[16:32], (password + k + owner) * 64, True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def prepared(password: bytes) -> bytes:
    """A password in the profile of strings for authentication: other blanks become spaces, characters that map to nothing
    go, compatible forms are composed; what is prohibited is an error. Bytes that are no UTF-8 stay."""
    try:
        text = password.decode()
    except UnicodeDecodeError:
        return password
    text = "".join(" " if stringprep.in_table_c12(c) else "" if stringprep.in_table_b1(c) else c for c in text)
    text = unicodedata.normalize("NFKC", text)
    banned = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9)
    if any(f(c) for c in text for f in banned):
        raise CryptError("InvalidPassword", "prohibited character")
    right = [stringprep.in_table_d1(c) for c in text]
    if any(right) and (any(map(stringprep.in_table_d2, text)) or not right[0] or not right[-1]):
        raise CryptError("InvalidPassword", "mixed directions")
    return text.encode()


@dataclass
class Decoder:
    key: bytes
    method: str
    encrypt_metadata: bool = True
    skip: int = -1

    @classmethod
    def open(cls, d: dict[str, Any], file_id: bytes, password: bytes) -> Decoder:
        version, revision = d.get("V", 0), d.get("R", 0)
        if version not in (1, 2, 4, 5, 6) or revision not in (2, 3, 4, 5, 6):
            raise CryptError("UnsupportedEncryption", f"V{version} R{revision}")
        method, bits = "V2", d.get("Length", 40)
        if version == 1:
            bits = 40
        if version >= 4:
            chosen = (d.get("CF") or {}).get(d.get("StmF", "Identity"))
            method = str(chosen.get("CFM", "None")) if isinstance(chosen, dict) else "None"
            bits = 256 if method == "AESV3" else 128
            if method == "AESV3" and version != 5:
                raise CryptError("UnsupportedEncryption", method)
        meta = d.get("EncryptMetadata", True) is not False
        key = cls._hard_key(d, revision, password) if revision >= 5 else cls._key(d, file_id, password, revision, max(5, min(16, bits // 8)), meta)
        return cls(key, method, meta)

    @staticmethod
    def _hard_key(d: dict[str, Any], revision: int, password: bytes) -> bytes:
        pw, u, o = prepared(password)[:127], d["U"][:48], d["O"][:48]
        digest = (lambda p, s, x=b"": hashlib.sha256(p + s + x).digest()) if revision == 5 else revision_6_hash
        if digest(pw, u[32:40]) == u[:32]:
            return aes_cbc(digest(pw, u[40:48]), bytes(16), d["UE"][:32], False)
        if digest(pw, o[32:40], u) == o[:32]:
            return aes_cbc(digest(pw, o[40:48], u), bytes(16), d["OE"][:32], False)
        raise CryptError("InvalidPassword")

    @staticmethod
    def _key(d: dict[str, Any], file_id: bytes, password: bytes, revision: int, size: int, meta: bool) -> bytes:
        rounds = 50 if revision >= 3 else 0

        def user_key(pw: bytes) -> bytes:
            k = hashlib.md5((pw + PADDING)[:32] + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"" if meta or revision < 4 else b"\xff" * 4)).digest()
            for _ in range(rounds):
                k = hashlib.md5(k[:size]).digest()
            return k[:size]

        def fits(key: bytes) -> bool:
            if revision == 2:
                return rc4(key, PADDING) == d["U"][:32]
            x = hashlib.md5(PADDING + file_id).digest()
            for i in range(20):
                x = rc4(_xor(key, bytes([i]) * size), x)
            return x == d["U"][:16]

        key = user_key(password)
        if fits(key):
            return key
        k = hashlib.md5((password + PADDING)[:32]).digest()
        for _ in range(rounds):
            k = hashlib.md5(k).digest()
        pw = d["O"][:32]
        for i in range(19, -1, -1) if revision >= 3 else [0]:
            pw = rc4(_xor(k[:size], bytes([i]) * size), pw)
        key = user_key(pw)
        if fits(key):
            return key
        raise CryptError("InvalidPassword")

    def object_key(self, number: int, gen: int) -> bytes:
        if self.method == "AESV3":
            return self.key
        salt = b"sAlT" if self.method == "AESV2" else b""
        return hashlib.md5(self.key + number.to_bytes(3, "little") + gen.to_bytes(2, "little") + salt).digest()[: min(16, len(self.key) + 5)]

    def decrypt(self, number: int, gen: int, data: bytes) -> bytes:
        if number == self.skip or not data or self.method == "None":
            return data
        key = self.object_key(number, gen)
        if self.method == "V2":
            return rc4(key, data)
        if len(data) < 32:
            raise CryptError("DecryptionFailure", "no block")
        return unpadded(aes_cbc(key, data[:16], data[16:], False))


def object_key_column(key_hex: str, number: Column, gen: Column, aes: bool) -> Column:
    """The key of each object as BINARY, on the JVM: a digest over file key, the low bytes of number and gen, and a salt."""
    low = lambda c, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(n)])
    data = F.concat(F.unhex(F.lit(key_hex)), low(number, 3), low(gen, 2), *([F.unhex(F.lit("73416C54"))] if aes else []))
    return F.substring(F.unhex(F.md5(data)), 1, min(16, len(key_hex) // 2 + 5))


def aes_decrypt_column(data: Column, key: Column) -> Column:
    """AES-CBC with the IV in front and PKCS padding, on the JVM."""
    return F.aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))
