"""AES over many blocks at once in numpy, and the old cipher of ZIP."""

from __future__ import annotations

import hashlib
import hmac
import zlib

import numpy as np

from ..errors import ArchiveError, corrupt


def _times(a: int, b: int) -> int:
    """Product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[np.ndarray, np.ndarray]:
    log, power, x = [0] * 256, [0] * 255, 1
    for i in range(255):
        power[i], log[x] = x, i
        x = _times(x, 3)
    box = []
    for v in range(256):
        b = power[-log[v] % 255] if v else 0
        y = b
        for k in range(1, 5):
            y ^= (b << k | b >> (8 - k)) & 0xFF
        box.append(y ^ 0x63)
    inverse = np.zeros(256, np.uint8)
    inverse[box] = np.arange(256)
    return np.array(box, np.uint8), inverse


_BOX, _INVERSE = _boxes()
_BY = {k: np.array([_times(v, k) for v in range(256)], np.uint8) for k in (2, 3, 9, 11, 13, 14)}
# Byte i of the state is row i % 4, column i // 4; a row moves left by its number.
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.argsort(_SHIFT)


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        words = [list(key[4 * i : 4 * i + 4]) for i in range(n)]
        constant = 1
        for i in range(n, 4 * (self.rounds + 1)):
            w = list(words[-1])
            if i % n == 0:
                w = [int(_BOX[x]) for x in w[1:] + w[:1]]
                w[0] ^= constant
                constant = _times(constant, 2)
            elif n > 6 and i % n == 4:
                w = [int(_BOX[x]) for x in w]
            words.append([a ^ b for a, b in zip(words[i - n], w)])
        self.keys = np.array(words, np.uint8).reshape(self.rounds + 1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[0]
        for r in range(1, self.rounds + 1):
            s = _BOX[s][:, _SHIFT]
            if r < self.rounds:
                c = s.reshape(-1, 4, 4)
                a, b, d, e = (np.roll(c, -k, 2) for k in range(4))
                s = (_BY[2][a] ^ _BY[3][b] ^ d ^ e).reshape(-1, 16)
            s = s ^ self.keys[r]
        return s

    def decrypt(self, blocks: np.ndarray) -> np.ndarray:
        s = blocks ^ self.keys[-1]
        for r in range(self.rounds - 1, -1, -1):
            s = _INVERSE[s[:, _UNSHIFT]] ^ self.keys[r]
            if r:
                c = s.reshape(-1, 4, 4)
                a, b, d, e = (np.roll(c, -k, 2) for k in range(4))
                s = (_BY[14][a] ^ _BY[11][b] ^ _BY[13][d] ^ _BY[9][e]).reshape(-1, 16)
        return s

    def ctr(self, raw: bytes) -> bytes:
        """WinZip's counter mode: little-endian, from one."""
        n = -(-len(raw) // 16)
        counters = np.zeros((n, 2), "<u8")
        counters[:, 0] = np.arange(1, n + 1)
        stream = self.encrypt(counters.view(np.uint8).reshape(-1, 16)).reshape(-1)[: len(raw)]
        return (np.frombuffer(raw, np.uint8) ^ stream).tobytes()

    def cbc(self, raw: bytes, iv: bytes) -> bytes:
        blocks = np.frombuffer(raw[: len(raw) // 16 * 16], np.uint8).reshape(-1, 16)
        if not len(blocks):
            return b""
        before = np.vstack([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]])
        return (self.decrypt(blocks) ^ before).tobytes()


def winzip_aes(raw: bytes, strength: int, password: bytes) -> bytes:
    key_size = {1: 16, 2: 24, 3: 32}.get(strength)
    if key_size is None:
        raise corrupt("AES strength")
    salt_size = key_size // 2
    if len(raw) < salt_size + 12:
        raise corrupt("AES data is cut short")
    salt, check, body, code = raw[:salt_size], raw[salt_size : salt_size + 2], raw[salt_size + 2 : -10], raw[-10:]
    keys = hashlib.pbkdf2_hmac("sha1", password, salt, 1000, 2 * key_size + 2)
    if keys[-2:] != check:
        raise ArchiveError("WRONG_PASSWORD")
    if hmac.new(keys[key_size : 2 * key_size], body, "sha1").digest()[:10] != code:
        raise corrupt("AES authentication code")
    return Aes(keys[:key_size]).ctr(body)


_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


class ZipCrypto:
    def __init__(self, password: bytes):
        self.k = [0x12345678, 0x23456789, 0x34567890]
        for b in password:
            self._update(b)

    def _update(self, b: int) -> None:
        k = self.k
        k[0] = k[0] >> 8 ^ _CRC[(k[0] ^ b) & 255]
        k[1] = ((k[1] + (k[0] & 255)) * 134775813 + 1) & 0xFFFFFFFF
        k[2] = k[2] >> 8 ^ _CRC[(k[2] ^ k[1] >> 24) & 255]

    def _byte(self) -> int:
        t = self.k[2] | 2
        return (t * (t ^ 1)) >> 8 & 255

    def decrypt(self, raw: bytes) -> bytes:
        out = bytearray()
        for b in raw:
            b ^= self._byte()
            out.append(b)
            self._update(b)
        return bytes(out)

    def encrypt(self, raw: bytes) -> bytes:
        out = bytearray()
        for b in raw:
            out.append(b ^ self._byte())
            self._update(b)
        return bytes(out)


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw)
