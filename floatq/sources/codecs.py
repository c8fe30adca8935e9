"""Codecs of chunks of doubles: ``encode`` to bytes, ``decode`` by the number of values.

The count, not an end mark, ends a chunk, so NaN is a value like any other. XOR codecs find the zero
bits of all values at once in numpy and loop only over what depends on the values before.
"""

from __future__ import annotations

import gzip
import math
import struct
from abc import ABC, abstractmethod
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard

from floatq.operators.stats import FRACTION_BITS

from .bits import Reader, Writer, leading, pack, trailing, unpack

U64 = np.uint64


def raw_bits(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, "<f8").view(np.uint64)


class Codec(ABC):
    """Subclass and ``register`` to add a codec."""

    name: str
    exact = True

    @abstractmethod
    def encode(self, values: np.ndarray) -> bytes: ...

    @abstractmethod
    def decode(self, data: bytes, n: int) -> np.ndarray: ...


class Uncompressed(Codec):
    name = "uncompressed"

    def encode(self, values: np.ndarray) -> bytes:
        return np.ascontiguousarray(values, "<f8").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return np.frombuffer(data, "<f8", n).copy()


class RunLength(Codec):
    """A count of fields, then (run of at most 255, value) fields; equal means equal bits."""

    name = "rle"

    def encode(self, values: np.ndarray) -> bytes:
        b = raw_bits(values)
        starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        length = np.diff(np.append(starts, len(b)))
        fields = -(-length // 255)
        at = np.repeat(starts, fields)
        runs = np.full(len(at), 255, np.uint8)
        if len(at):
            runs[np.cumsum(fields) - 1] = length - 255 * (fields - 1)
        out = np.zeros(len(at), np.dtype([("run", "u1"), ("bits", "<u8")]))
        out["run"], out["bits"] = runs, b[at]
        return struct.pack("<Q", len(out)) + out.tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        fields = np.frombuffer(data, np.dtype([("run", "u1"), ("bits", "<u8")]), struct.unpack_from("<Q", data)[0], 8)
        return np.repeat(fields["bits"], fields["run"]).view("<f8")


class ByteSliced(Codec):
    """Fixed-point deltas against the least value as byte columns, highest first, and the odd bits last.

    Values are truncated to the fraction bits of ``digits`` decimal digits.
    """

    name = "buff"
    exact = False

    def __init__(self, digits: int = 2) -> None:
        self.fraction = FRACTION_BITS[digits]

    def encode(self, values: np.ndarray) -> bytes:
        scaled = np.asarray(values, float) * float(1 << self.fraction)
        if not np.isfinite(scaled).all() or (len(scaled) and np.abs(scaled).max() >= 2.0**62):
            raise ValueError("a value has no fixed-point form of 63 bits")
        fixed = np.trunc(scaled).astype(np.int64)
        base = int(fixed.min()) if len(fixed) else 0
        delta = (fixed - base).astype(np.uint64)
        width = int(delta.max()).bit_length() if len(delta) else 0
        columns, rest = divmod(width, 8)
        sliced = b"".join((delta >> U64(width - 8 * (k + 1)) & U64(255)).astype(np.uint8).tobytes() for k in range(columns))
        odd = pack(delta & U64((1 << rest) - 1), np.full(len(delta), rest)) if rest else b""
        return struct.pack("<qIQ", base, width, len(delta)) + sliced + odd

    def decode(self, data: bytes, n: int, digits: int | None = None) -> np.ndarray:
        """``digits``: read only the byte columns that so many digits need."""
        base, width, _ = struct.unpack_from("<qIQ", data)
        columns, rest = divmod(width, 8)
        unneeded = 0 if digits is None else max(0, self.fraction - FRACTION_BITS[digits])
        delta = np.zeros(n, np.uint64)
        for k in range(columns):
            left = width - 8 * (k + 1)
            delta |= np.frombuffer(data, np.uint8, n, 20 + k * n).astype(np.uint64) << U64(left)
            # After the first column: stop where only unneeded bits are left.
            if digits is not None and left and left <= unneeded:
                return (delta.astype(np.int64) + base) / float(1 << self.fraction)
        if rest:
            delta |= unpack(data[20 + columns * n :], rest, n)
        return (delta.astype(np.int64) + base) / float(1 << self.fraction)


class DeltaPacked(Codec):
    """round(value * scale), then zigzag deltas of one width."""

    name = "sprintz"
    exact = False

    def __init__(self, scale: int = 100) -> None:
        self.scale = scale

    def encode(self, values: np.ndarray) -> bytes:
        scaled = np.asarray(values, float) * self.scale
        if not np.isfinite(scaled).all() or (len(scaled) and np.abs(scaled).max() >= 2.0**61):
            raise ValueError("a value has no integer of 62 bits at this scale")
        q = (np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)).astype(np.int64)
        delta = np.diff(q, prepend=q[:1])
        z = ((delta << 1) ^ (delta >> 63)).view(np.uint64)
        width = int(np.bitwise_or.reduce(z)).bit_length() if len(z) else 0
        return struct.pack(">qIB", int(q[0]) if len(q) else 0, self.scale, width) + pack(z, np.full(len(z), width))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        first, scale, width = struct.unpack_from(">qIB", data)
        z = unpack(data[13:], width, n)
        delta = (z >> U64(1)).astype(np.int64) ^ -(z & U64(1)).astype(np.int64)
        return (first + np.cumsum(delta)) / scale


class XorCodec(Codec):
    """The first value, then the XOR of each value with the one before. A coder is a subclass that says how XORs become bit fields and back."""

    @abstractmethod
    def fields(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and widths (n x k, unsigned) of the bit fields of XORs, in order; a width of 0 is no field."""

    @abstractmethod
    def xors(self, r: Reader, n: int) -> Iterator[int]:
        """The next n XORs."""

    def encode_bits(self, b: np.ndarray) -> bytes:
        if not len(b):
            return b""
        values, widths = self.fields(b[1:] ^ b[:-1])
        return pack(np.append(b[:1], values.ravel().astype(np.uint64)), np.append(64, widths.ravel()))

    def decode_bits(self, data: bytes, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint64)
        r = Reader(data)
        first = r.read(64)
        return np.bitwise_xor.accumulate(np.fromiter(chain([first], self.xors(r, n - 1)), np.uint64, n))

    def encode(self, values: np.ndarray) -> bytes:
        return self.encode_bits(raw_bits(values))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return self.decode_bits(data, n).view("<f8")


def _fields(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((n, k), np.uint64), np.zeros((n, k), np.int64)


class Gorilla(XorCodec):
    """XOR with the value before: 0, or 10 and the bits of the last window, or 11, a window and its bits."""

    name = "gorilla"

    def fields(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lead, trail = np.minimum(leading(x), 31), trailing(x)
        there = np.flatnonzero(x)
        # Only the windows follow from one another; the fields are made at once.
        p, q, opens = 65, 65, []
        for i, (a, b) in enumerate(zip(lead[there].tolist(), trail[there].tolist(), strict=True)):
            if a < p or b < q:
                p, q = a, b
                opens.append(i)
        fresh = np.zeros(len(there), bool)
        fresh[opens] = True
        window = there[np.array(opens, np.int64)[np.cumsum(fresh) - 1]] if len(there) else there
        p, q = lead[window], trail[window]
        values, widths = _fields(len(x), 4)
        widths[:, 0] = 1
        values[there, 0], widths[there, 0] = 2 + fresh, 2
        values[there, 1], widths[there, 1] = p, 5 * fresh
        values[there, 2], widths[there, 2] = 63 - p - q, 6 * fresh
        values[there, 3], widths[there, 3] = x[there] >> q.astype(np.uint64), 64 - p - q
        return values, widths

    def xors(self, r: Reader, n: int) -> Iterator[int]:
        p = q = 0
        for _ in range(n):
            if not r.read(1):
                yield 0
                continue
            if r.read(1):
                p = r.read(5)
                q = 63 - p - r.read(6)
            yield r.read(64 - p - q) << q


#: The leading-zero counts that three bits name.
LEAD_CLASSES = [0, 8, 12, 16, 18, 20, 22, 24]
LEAD_CLASS_OF = [max(i for i, c in enumerate(LEAD_CLASSES) if c <= n) for n in range(65)]


class Chimp(XorCodec):
    """XOR with the value before under four two-bit flags; more than 6 trailing zeros earn a centre field."""

    name = "chimp"
    threshold = 6

    def fields(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trail = trailing(x)
        c = np.array(LEAD_CLASS_OF)[leading(x)]
        p = np.array(LEAD_CLASSES)[c]
        centre = (x != 0) & (trail > self.threshold)
        whole = (x != 0) & ~centre
        # The class stored last is that of the value before, if that was written whole too.
        again = whole & np.append(False, whole[:-1] & (p[1:] == p[:-1])) if len(x) else whole
        values, widths = _fields(len(x), 4)
        values[:, 0], widths[:, 0] = np.where(centre, 1, np.where(again, 2, np.where(whole, 3, 0))), 2
        values[:, 1], widths[:, 1] = c, 3 * (centre | (whole & ~again))
        values[:, 2], widths[:, 2] = np.where(centre, 64 - p - trail, 0), 6 * centre
        values[:, 3], widths[:, 3] = x >> np.where(centre, trail, 0).astype(np.uint64), np.where(centre, 64 - p - trail, np.where(whole, 64 - p, 0))
        return values, widths

    def xors(self, r: Reader, n: int) -> Iterator[int]:
        stored = 0
        for _ in range(n):
            flag = r.read(2)
            if flag == 0:
                yield 0
            elif flag == 1:
                p, size = LEAD_CLASSES[r.read(3)], r.read(6)
                yield r.read(size) << 64 - p - size
            else:
                if flag == 3:
                    stored = LEAD_CLASSES[r.read(3)]
                yield r.read(64 - stored)


class Chimp128(Codec):
    """As Chimp, against the best of 128 values before: the last with the same 14 low bits, if that helps."""

    name = "chimp128"
    previous, low, threshold = 128, 14, 13

    def encode(self, values: np.ndarray) -> bytes:
        b = raw_bits(values).tolist()
        out, seen, stored = Writer(), {}, -1
        for i, v in enumerate(b):
            key = v & (1 << self.low) - 1
            if not i:
                out.put(v, 64)
                seen[key] = 0
                continue
            at = seen.get(key, -self.previous - 1)
            seen[key] = i
            far = at > i - self.previous and at >= 0
            x = v ^ b[at] if far else 0
            if far and (x == 0 or (x & -x).bit_length() - 1 > self.threshold):
                if not x:
                    out.put(at % self.previous, 9)
                    stored = -1
                    continue
                q = (x & -x).bit_length() - 1
                c = LEAD_CLASS_OF[64 - x.bit_length()]
                p = LEAD_CLASSES[c]
                out.put(1 << 16 | at % self.previous << 9 | c << 6 | (64 - p - q) & 63, 18)
                out.put(x >> q, 64 - p - q)
                stored = -1
                continue
            x = v ^ b[i - 1]
            if not x:
                out.put((i - 1) % self.previous, 9)
                stored = -1
                continue
            c = LEAD_CLASS_OF[64 - x.bit_length()]
            p = LEAD_CLASSES[c]
            if p == stored:
                out.put(2, 2)
            else:
                out.put(3, 2)
                out.put(c, 3)
                stored = p
            out.put(x, 64 - p)
        return out.done()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        r = Reader(data)
        out = [r.read(64)] if n else []
        stored = 0
        for i in range(1, n):
            back = lambda at: i - 1 - (i - 1 - at) % self.previous  # noqa: B023, E731
            flag = r.read(2)
            if flag == 0:
                out.append(out[back(r.read(7))])
            elif flag == 1:
                at, p, size = r.read(7), LEAD_CLASSES[r.read(3)], r.read(6)
                out.append(out[back(at)] ^ r.read(size) << 64 - p - size)
            else:
                if flag == 3:
                    stored = LEAD_CLASSES[r.read(3)]
                out.append(out[-1] ^ r.read(64 - stored))
        return np.array(out, np.uint64).view("<f8")


def significant(v: float) -> tuple[int, int]:
    """Decimal places of the shortest decimal form of a positive number, and the power of its first digit."""
    digits, exponent = f"{v!r}" if "e" in f"{v!r}" else f"{v!r}e0", 0
    mantissa, power = digits.split("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = fraction.rstrip("0")
    exponent = int(power)
    return max(0, len(fraction) - exponent), math.floor(math.log10(v))


class Elf(Codec):
    """Erases low mantissa bits that the count of significant digits brings back, then codes the XOR.

    Each value is 10 (as it is), 0 (erased, as many digits as before) or 11 and the digits (erased).
    """

    name = "elf"

    def erase(self, values: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Bits to code, and for each value its significant digits, or -1 where nothing is erased."""
        b = raw_bits(values).copy()
        kept = [-1] * len(b)
        for i, v in enumerate(np.asarray(values).tolist()):
            if v == 0 or not math.isfinite(v) or abs(v) < 2.3e-308:
                continue
            alpha, first = significant(abs(v))
            beta = alpha + first + 1
            if not 0 < beta < 16:
                continue
            # A unit of the last place needs ceil(alpha * log2 10) bits after the point.
            low = 52 - (math.ceil(alpha * math.log2(10)) + ((int(b[i]) >> 52 & 0x7FF) - 1023))
            if low <= 4:
                continue
            low = min(low, 52)
            erased = int(b[i]) >> low << low
            if erased != int(b[i]) and self.recover(erased, beta) == v:
                b[i], kept[i] = erased, beta
        return b, kept

    @staticmethod
    def recover(bits: int, beta: int) -> float:
        """The least number of ``beta`` significant digits that is not nearer to zero."""
        v = struct.unpack("<d", struct.pack("<Q", bits))[0]
        if v == 0:
            return v
        size = abs(v)
        places = beta - math.floor(math.log10(size)) - 1
        if places > 300:
            return v
        from decimal import ROUND_UP, Decimal

        out = float(Decimal(size).quantize(Decimal(1).scaleb(-places), rounding=ROUND_UP)) if -places < 300 else size
        return math.copysign(out, v)

    def encode(self, values: np.ndarray) -> bytes:
        b, kept = self.erase(values)
        flags, last = Writer(), None
        for beta in kept:
            if beta < 0:
                flags.put(2, 2)
            elif beta == last:
                flags.put(0, 1)
            else:
                flags.put(48 | beta, 6)
                last = beta
        head, body = flags.done(), self.code(b)
        return struct.pack("<I", len(head)) + head + body

    def decode(self, data: bytes, n: int) -> np.ndarray:
        size = struct.unpack_from("<I", data)[0]
        flags = Reader(data[4 : 4 + size])
        b = self.uncode(data[4 + size :], n)
        out, beta = b.view("<f8").copy(), 0
        for i in range(n):
            if flags.read(1):
                if not flags.read(1):
                    continue
                beta = flags.read(4)
            out[i] = self.recover(int(b[i]), beta)
        return out

    def code(self, b: np.ndarray) -> bytes:
        """First value by its trailing zeros; then 01 (equal), 00 (same window), 10 (short centre), 11."""
        out = Writer()
        if not len(b):
            return b""
        first = int(trailing(b[:1])[0])
        out.put(first, 7)
        out.put(int(b[0]) >> first if first < 64 else 0, 64 - first)
        x = b[1:] ^ b[:-1]
        window = None
        for v, p, q in zip(x.tolist(), leading(x).tolist(), trailing(x).tolist(), strict=True):
            if not v:
                out.put(1, 2)
                continue
            c = LEAD_CLASS_OF[p]
            p = LEAD_CLASSES[c]
            if window and p == window[0] and q >= window[1]:
                out.put(0, 2)
                out.put(v >> window[1], 64 - window[0] - window[1])
                continue
            window = (p, q)
            centre = 64 - p - q
            short = centre <= 16
            out.put(2 if short else 3, 2)
            out.put(c, 3)
            out.put(centre - 1, 4 if short else 6)
            out.put(v >> q, centre)
        return out.done()

    def uncode(self, data: bytes, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, np.uint64)
        r = Reader(data)
        first = r.read(7)
        out = [r.read(64 - first) << first if first < 64 else 0]
        p = q = 0
        for _ in range(n - 1):
            flag = r.read(2)
            if flag == 1:
                out.append(out[-1])
                continue
            if flag:
                p = LEAD_CLASSES[r.read(3)]
                q = 64 - p - (r.read(4 if flag == 2 else 6) + 1)
            out.append(out[-1] ^ r.read(64 - p - q) << q)
        return np.array(out, np.uint64)


class ElfOnChimp(Elf):
    """Erasing as Elf, coding as Chimp."""

    name = "elf_on_chimp"

    def code(self, b: np.ndarray) -> bytes:
        return Chimp().encode_bits(b)

    def uncode(self, data: bytes, n: int) -> np.ndarray:
        return Chimp().decode_bits(data, n)


class Zstd(Uncompressed):
    name = "zstd"

    def __init__(self, level: int = 3) -> None:
        self.level = level

    def encode(self, values: np.ndarray) -> bytes:
        return zstandard.ZstdCompressor(level=self.level).compress(super().encode(values))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return super().decode(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * n), n) if n else np.zeros(0)


class Gzip(Uncompressed):
    name = "gzip"

    def __init__(self, level: int = 6) -> None:
        self.level = level

    def encode(self, values: np.ndarray) -> bytes:
        return gzip.compress(super().encode(values), self.level, mtime=0)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        return super().decode(gzip.decompress(data), n)


class Snappy(Uncompressed):
    """Blocks of raw snappy with a length before each; a block holds 64 KiB."""

    name = "snappy"
    block = 1 << 16

    def encode(self, values: np.ndarray) -> bytes:
        raw = super().encode(values)
        out = []
        for i in range(0, len(raw), self.block):
            packed = pa.compress(raw[i : i + self.block], "snappy", asbytes=True)
            out.append(struct.pack("<II", len(packed), len(raw[i : i + self.block])) + packed)
        return b"".join(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out, at = [], 0
        while at < len(data):
            size, plain = struct.unpack_from("<II", data, at)
            out.append(pa.decompress(data[at + 8 : at + 8 + size], plain, "snappy", asbytes=True))
            at += 8 + size
        return super().decode(b"".join(out), n)


class Alp(Codec):
    """Adaptive lossless floating point: decimals as integers under one pair of powers per vector.

    A vector of 1024 values is round(v * 10^e / 10^f); values that this does not bring back bit by bit are exceptions,
    kept as they are with their places. The integers are packed against their least.
    """

    name = "alp"
    vector = 1024
    pairs = [(e, f) for e in range(18, -1, -1) for f in range(min(e, 10), -1, -1)]

    @staticmethod
    def try_pair(v: np.ndarray, e: int, f: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            scaled = v * 10.0**e / 10.0**f
            fits = np.isfinite(scaled) & (np.abs(scaled) < 2.0**51)
            q = np.where(fits, np.rint(scaled), 0).astype(np.int64)
            back = q * 10.0**f / 10.0**e
        return q, fits & (raw_bits(back) == raw_bits(v))

    def choose(self, v: np.ndarray) -> tuple[int, int]:
        """The pair of the least estimated bits on a sample of the vector."""
        sample = v[:: max(1, len(v) // 32)]
        best, least = (0, 0), math.inf
        for e, f in self.pairs:
            q, good = self.try_pair(sample, e, f)
            span = int(q[good].max() - q[good].min()).bit_length() if good.any() else 0
            cost = len(sample) * span + 80 * int((~good).sum())
            if cost < least:
                best, least = (e, f), cost
        return best

    def encode(self, values: np.ndarray) -> bytes:
        values = np.ascontiguousarray(values, "<f8")
        out = []
        for i in range(0, len(values), self.vector):
            v = values[i : i + self.vector]
            e, f = self.choose(v)
            q, good = self.try_pair(v, e, f)
            base = int(q[good].min()) if good.any() else 0
            delta = np.where(good, q - base, 0).astype(np.uint64)
            width = int(delta.max()).bit_length()
            bad = np.flatnonzero(~good).astype("<u2")
            out.append(struct.pack("<BBBHq", e, f, width, len(bad), base) + pack(delta, np.full(len(v), width)) + bad.tobytes() + v[bad].tobytes())
        return b"".join(out)

    def decode(self, data: bytes, n: int) -> np.ndarray:
        out, at = np.empty(n), 0
        for i in range(0, n, self.vector):
            m = min(self.vector, n - i)
            e, f, width, bad, base = struct.unpack_from("<BBBHq", data, at)
            at += 13
            size = (width * m + 7) // 8
            delta = unpack(data[at : at + size], width, m)
            out[i : i + m] = (delta.astype(np.int64) + base) * 10.0**f / 10.0**e
            at += size
            places = np.frombuffer(data, "<u2", bad, at)
            out[i + places.astype(np.int64)] = np.frombuffer(data, "<f8", bad, at + 2 * bad)
            at += 10 * bad
        return out


CODECS: dict[str, type[Codec]] = {}


def register(codec: type[Codec]) -> None:
    CODECS[codec.name] = codec


for _codec in (Uncompressed, RunLength, ByteSliced, Gorilla, Chimp, Chimp128, ElfOnChimp, Elf, DeltaPacked, Zstd, Gzip, Snappy, Alp):
    register(_codec)


def make(name: str, **options: int) -> Codec:
    if name not in CODECS:
        raise ValueError(f"unknown codec {name}; there are {', '.join(CODECS)}")
    return CODECS[name](**options)
