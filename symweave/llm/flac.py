"""FLAC media columns: 8-bit mono streams, encoded and decoded for many frames at once.

Frames hold BLOCK samples.  For each frame the encoder takes a constant, the samples themselves, or the best of the fixed
predictors (order 0 to 4) and of linear predictors fitted to the frame (LPC, orders LPC_ORDERS), with Rice residuals in one to
eight partitions.  Every POINT frames have a seek point.  Streams are read from seek point to seek point: frames are found by their
headers (CRC-8) and the checksums at their ends (CRC-16), Rice residuals and predictors are decoded for all frames of a run in step,
and blocks of PCM come out with their first sample and their offset in the stream; the MD5 of all samples is verified at the end.
Both ways work in runs of frames (CODED, RUN), so a long text needs little more memory than its payload and its stream.

The reader takes any stream of 8-bit mono frames in order (all block sizes, fixed and linear predictors, both Rice codings, escapes)
whose metadata hold a seek table; `seekable=False` reads streams without one.

Defined cases: a null text is an empty payload; payloads are padded with spaces to a positive multiple of PAD bytes;
equal texts give equal streams; a damaged stream raises ValueError; an empty table gives an empty result; other columns may
have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symweave.llm.shared import slices, text_bytes

BLOCK = PAD = 192
RATE, POINT, RUN = 8000, 64, 4096
#: Frames that are encoded at a time; their tables fit a core's cache.
CODED = 512
#: Fixed predictors: what each of the last samples counts for, latest first.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])
LPC_ORDERS, PRECISION, PARTITIONS = (2, 4, 8), 10, 8
SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
#: Fixed values of the format: samples of a frame and rates by the codes of a frame's header (0: not given there).
BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
RATES = np.array([0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000, 0, 0, 0, 0])


def _crc_table(poly: int, width: int) -> np.ndarray:
    table, top = [], 1 << (width - 1)
    for n in range(256):
        c = n << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & top else c << 1
        table.append(c & ((1 << width) - 1))
    return np.array(table, np.uint8 if width == 8 else np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: Leading zero bits of 16.
ZEROS16 = np.array([16 - int(n).bit_length() for n in range(1 << 16)], np.uint8)


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC of each span. Spans are aligned at their ends: zeros before a span leave a CRC that starts at zero as it is."""
    crc = np.zeros(len(starts), table.dtype)
    for back in range(int((ends - starts).max(initial=0)), 0, -1):
        at = ends - back
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint8)
        crc = table[crc ^ byte] if table is CRC8 else (crc << np.uint16(8)) ^ table[(crc >> np.uint16(8)).astype(np.uint8) ^ byte]
    return crc


def _number_sizes(n: np.ndarray) -> np.ndarray:
    """Bytes of the coded frame numbers."""
    return 1 + sum((n >= 1 << bits).astype(np.int64) for bits in (7, 11, 16, 21, 26, 31))


# --- writing ---------------------------------------------------------------------------------------------------------


def _predictors(s: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Quantised coefficients of each order of LPC_ORDERS and their common shift, from each frame's own correlations.

    Sums are of whole numbers and all else is element by element, so a frame gives the same coefficients in any company.
    """
    most = max(LPC_ORDERS)
    wide = s.astype(np.int64)
    r = [(wide[:, lag:] * wide[:, : BLOCK - lag]).sum(1).astype(float) for lag in range(most + 1)]
    error = r[0] * (1 + 2.0**-30) + 2.0**-10
    a: list[np.ndarray] = []
    found = {}
    for i in range(most):
        reflect = r[i + 1].copy()
        for j in range(i):
            reflect -= a[j] * r[i - j]
        reflect /= error
        a = [a[j] - reflect * a[i - 1 - j] for j in range(i)] + [reflect]
        error = np.maximum(error * (1 - reflect * reflect), 2.0**-10)
        if i + 1 in LPC_ORDERS:
            found[i + 1] = np.stack(a, 1)
    largest = np.max([np.abs(c).max(1) for c in found.values()], 0)
    shift = np.clip(PRECISION - 1 - np.frexp(largest)[1], 0, 15)
    top = (1 << PRECISION - 1) - 1
    return shift.astype(np.int32), {o: np.clip(np.rint(np.ldexp(c, shift[:, None])), -top - 1, top).astype(np.int32) for o, c in found.items()}


def _estimate(r: np.ndarray, skip: int) -> np.ndarray:
    """About the bits that residuals take, from their mean size."""
    total = 2 * np.abs(r[:, skip:]).sum(1, dtype=np.int64)
    n = r.shape[1] - skip
    k = np.maximum(0, np.frexp((total // n).astype(float))[1] - 1)
    return n * (k + 1) + (total >> k)


def _partitioned(u: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cheapest partition order of each frame, Rice parameters by sample, and bits of the residual without its header."""
    n, per = len(u), BLOCK // PARTITIONS
    count = np.full((n, PARTITIONS), per)
    count[:, 0] -= order
    most = min(14, int(u.max(initial=0)).bit_length())
    cost = np.stack([(u >> np.uint32(k)).reshape(n, PARTITIONS, per).sum(2, dtype=np.int64) + count * (k + 1) for k in range(most + 1)], 2)
    best, chosen, shown = None, None, None
    for level in range(PARTITIONS.bit_length() - 1, -1, -1):
        total = cost.min(2).sum(1) + 4 * (1 << level)
        k = np.repeat(cost.argmin(2), BLOCK >> level, axis=1)
        if best is None:
            best, chosen, shown = total, np.full(n, level), k
        else:
            better = total <= best
            best, chosen, shown = np.where(better, total, best), np.where(better, level, chosen), np.where(better[:, None], k, shown)
        if level:
            cost = cost[:, 0::2] + cost[:, 1::2]
    return chosen, shown, best


def _packed(size: int, fields: list[tuple[np.ndarray, np.ndarray | int, np.ndarray]]) -> np.ndarray:
    """`size` bytes in which fields (first bit, width up to 32, value) stand and all else is zero; no two fields share a bit."""
    words = np.zeros(size // 4 + 3)
    for at, width, value in fields:
        window = value.astype(np.uint64) << (64 - width - (at & 31)).astype(np.uint64)
        word = at >> 5
        words += np.bincount(word, window >> np.uint64(32), len(words))
        words[1:] += np.bincount(word, window & np.uint64(0xFFFFFFFF), len(words))[:-1]
    return words.astype(">u4").view(np.uint8)[:size]


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of frames (rows of samples) end to end, and their sizes."""
    count = len(samples)
    s = samples.astype(np.int32)
    choices: list[tuple[int, np.ndarray]] = [(0, s)]  # residuals by order; the first `order` columns do not count
    for k in range(1, len(FIXED)):
        choices.append((k, np.diff(choices[-1][1], axis=1, prepend=0)))
    bits = [_estimate(r, max(FIXED.shape[1], o)) + 8 * o for o, r in choices]
    shift, coefficients = _predictors(s)
    for o in LPC_ORDERS:
        guess = np.zeros_like(s)
        for j in range(o):
            guess[:, o:] += coefficients[o][:, j : j + 1] * s[:, o - 1 - j : BLOCK - 1 - j]
        r = s - (guess >> shift[:, None])
        choices.append((o, r))
        bits.append(_estimate(r, max(FIXED.shape[1], o)) + (8 + PRECISION) * o + 9)
    pick = np.stack(bits, 1).argmin(1)
    order = np.array([o for o, _ in choices])[pick]
    lpc = pick >= len(FIXED)
    r = np.zeros_like(s)
    for k, (o, own) in enumerate(choices):
        if len(at := np.flatnonzero(pick == k)):
            r[at, o:] = own[at, o:]
    u = ((r << 1) ^ (r >> 31)).astype(np.uint32)
    level, parameter, rice = _partitioned(u, order)
    lead = np.where(lpc, 9 + PRECISION * order, 0)  # bits before the residual's header
    coded_bits = 8 * order + lead + 6 + rice
    constant = (s == s[:, :1]).all(1)
    verbatim = ~constant & (coded_bits >= 8 * BLOCK)
    coded = ~constant & ~verbatim
    body = np.where(constant, 8, np.where(verbatim, 8 * BLOCK, coded_bits))
    head = 5 + _number_sizes(numbers)
    size = head + 1 + (body + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros(int(ends[-1]), np.uint8)
    out[starts], out[starts + 1], out[starts + 2], out[starts + 3] = 0xFF, 0xF8, 0x14, 0x02
    for length in np.unique(head - 5).tolist():
        at, n = starts[head == length + 5] + 4, numbers[head == length + 5]
        if length == 1:
            out[at] = n
        else:
            out[at] = (0xFF00 >> length) & 0xFF | n >> 6 * (length - 1)
            for j in range(1, length):
                out[at + j] = 0x80 | n >> 6 * (length - 1 - j) & 0x3F
    sub = starts + head
    out[sub] = np.where(constant, 0, np.where(verbatim, 2, np.where(lpc, 31 + order, 8 + order) << 1))
    raw = samples.view(np.uint8)
    out[sub[constant] + 1] = raw[constant, 0]
    if verbatim.any():
        out[(sub[verbatim] + 1)[:, None] + np.arange(BLOCK)] = raw[verbatim]
    for j in range(int(order.max(initial=0))):
        warm = coded & (order > j)
        out[sub[warm] + 1 + j] = raw[warm, j]
    at = np.flatnonzero(coded)
    if len(at):
        k, order, u, level, lead, lpc = parameter[at], order[at], u[at], level[at], lead[at], lpc[at]
        bytes_ = size[at] - head[at] - 1 - order - 2  # from the last warm-up sample to the CRC
        first = 8 * (np.cumsum(bytes_) - bytes_)
        fields: list[tuple[np.ndarray, np.ndarray | int, np.ndarray]] = []
        for row, o in ((np.flatnonzero(lpc & (order == o)), o) for o in LPC_ORDERS):
            if len(row):
                fields.append((first[row], 4, np.full(len(row), PRECISION - 1)))
                fields.append((first[row] + 4, 5, shift[at[row]]))
                for j in range(o):
                    fields.append((first[row] + 9 + PRECISION * j, PRECISION, coefficients[o][at[row], j] & (1 << PRECISION) - 1))
        first = first + lead
        fields.append((first + 2, 4, level))
        place = np.arange(BLOCK)
        opens = place[None, :] % (BLOCK >> level)[:, None] == 0
        used = place >= order[:, None]
        q = (u >> k.astype(np.uint32)).astype(np.int64)
        width = np.where(used, q + 1 + k, 0)
        start = (first + 6)[:, None] + np.cumsum(width + 4 * opens, 1) - width
        fields.append(((start - 4)[opens], 4, k[opens]))
        low = k[used]
        fields.append(((start + q)[used], low + 1, u[used].astype(np.int64) & (1 << low) - 1 | 1 << low))
        packed = _packed(int(bytes_.sum()), fields)
        into = np.repeat(sub[at] + 1 + order - (first - lead) // 8, bytes_) + np.arange(len(packed))
        out[into] = packed
    out[sub - 1] = _crcs(out, starts, sub - 1, CRC8)
    crc = _crcs(out, starts, ends - 2, CRC16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 0xFF
    return out, size


def encode(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """One FLAC stream for each payload; payloads stand end to end, each a positive multiple of BLOCK bytes."""
    samples = (payload ^ np.uint8(128)).view(np.int8).reshape(-1, BLOCK)
    frames = sizes // BLOCK
    after = np.cumsum(frames)
    numbers = np.arange(len(samples)) - np.repeat(after - frames, frames)
    runs = [encode_frames(samples[a : a + CODED], numbers[a : a + CODED]) for a in range(0, len(samples), CODED)]
    data, size = np.concatenate([x for x, _ in runs]), np.concatenate([x for _, x in runs])
    at = np.concatenate([[0], np.cumsum(size)])
    streams = []
    for n, last in zip(frames.tolist(), after.tolist()):
        first = last - n
        own = size[first:last]
        starts = np.arange(0, n, POINT)
        seek = np.zeros(len(starts), SEEK)
        seek["sample"], seek["offset"], seek["samples"] = starts * BLOCK, at[first + starts] - at[first], BLOCK
        facts = RATE << 44 | 7 << 36 | n * BLOCK
        info = BLOCK.to_bytes(2) * 2 + int(own.min()).to_bytes(3) + int(own.max()).to_bytes(3) + facts.to_bytes(8) + hashlib.md5(samples[first:last]).digest()
        table = seek.tobytes()
        streams.append(b"".join([b"fLaC\x00", len(info).to_bytes(3), info, b"\x83", len(table).to_bytes(3), table, data[at[first] : at[last]].tobytes()]))
    return streams


# --- reading ---------------------------------------------------------------------------------------------------------


@dataclass
class Stream:
    """What a stream's metadata say, and where its frames start."""

    data: np.ndarray
    frames: int
    least: int
    most: int
    smallest: int
    largest: int
    rate: int
    total: int
    digest: bytes
    points: np.ndarray


def _parsed(stream: bytes, seekable: bool) -> Stream:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, b"", None
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the metadata end early")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if len(body) < size or (kind == 0) != (at == 4) or kind == 0 and size != 34 or kind == 3 and size % SEEK.itemsize:
            raise ValueError("a metadata block of a wrong size or at a wrong place")
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, SEEK)
            points = points[points["sample"] != (1 << 64) - 1]
        at += 4 + size
    if points is None or not len(points):
        if seekable:
            raise ValueError("no seek table")
        points = np.zeros(1, SEEK)
        points["samples"] = int.from_bytes(info[:2])
    facts = int.from_bytes(info[10:18])
    if facts >> 36 & 0xFF != 7:
        raise ValueError("only 8-bit mono streams are read")
    offsets = points["offset"]
    if int(offsets[0]) or int(points["sample"][0]) or int(offsets.max()) >= len(stream) - at or (np.diff(offsets.astype(np.int64)) <= 0).any():
        raise ValueError("seek points are out of order")
    number = [int.from_bytes(info[a:b]) for a, b in ((0, 2), (2, 4), (4, 7), (7, 10))]
    return Stream(np.frombuffer(stream, np.uint8), at, *number, facts >> 44, facts & (1 << 36) - 1, info[18:34], points)


@dataclass
class Frames:
    """Frames found in bytes that stand end to end."""

    starts: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    sizes: np.ndarray
    rates: np.ndarray
    subframes: np.ndarray


def _headers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, Frames]:
    """Which of the places hold a frame's header, and what it says. data has 16 bytes to spare."""
    size_code, rate_code = data[at + 2] >> 4, data[at + 2] & 15
    good = (data[at] == 0xFF) & (data[at + 1] == 0xF8) & (size_code > 0) & (rate_code < 15) & ((data[at + 3] & 0xF7 == 0x00) & (data[at + 3] & 8 == 0) | (data[at + 3] == 0x02))
    lead = data[at + 4].astype(np.int64)
    length = np.where(lead < 0x80, 1, np.minimum(ZEROS16[((~lead & 0xFF) << 8)].astype(np.int64), 7))
    good &= (lead < 0x80) | (length >= 2)
    number = np.where(length == 1, lead, lead & (0x7F >> length))
    for j in range(1, 7):
        number = np.where(j < length, number << 6 | data[at + 4 + j] & 0x3F, number)
    place = at + 4 + length
    size = BLOCK_SIZES[size_code]
    size = np.where(size_code == 6, data[place].astype(np.int64) + 1, np.where(size_code == 7, (data[place].astype(np.int64) << 8 | data[place + 1]) + 1, size))
    place = place + np.where(size_code == 6, 1, 0) + np.where(size_code == 7, 2, 0) + np.where(rate_code == 12, 1, 0) + np.where(rate_code > 12, 2, 0)
    good &= _crcs(data, at, place, CRC8) == data[place]
    return good, Frames(at, at, number, size, RATES[rate_code], place + 1)


def _whole(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span ends with the CRC-16 of what it holds."""
    crc = _crcs(padded, starts, np.maximum(ends - 2, starts), CRC16)
    return (ends - starts > 6) & (crc >> 8 == padded[ends - 2]) & (crc & 0xFF == padded[ends - 1])


def _chain(padded: np.ndarray, at: np.ndarray, number: np.ndarray, end: int) -> np.ndarray:
    """The headers of one run of frames that are no accident: each frame's CRC-16 holds up to a header of the next number, or to the end."""
    kept, k = [], 0
    while k < len(at):
        kept.append(at[k])
        later = k + 1 + np.flatnonzero(number[k + 1 :] == number[k] + 1)
        for nxt in [*later.tolist(), len(at)]:
            stop = end if nxt == len(at) else int(at[nxt])
            if _whole(padded, at[k : k + 1], np.array([stop]))[0]:
                break
        else:
            raise ValueError("a frame's CRC-16 differs")
        k = nxt
    return np.array(kept)


def _found(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Frames:
    """The frames of runs of bytes, each of which starts with a frame: every header whose frame before it has a right CRC-16."""
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    at = np.flatnonzero((padded[: len(data)] == 0xFF) & (padded[1 : len(data) + 1] == 0xF8))
    good, seen = _headers(padded, at)
    at, number = at[good], seen.numbers[good]
    if not np.isin(starts, at).all():
        raise ValueError("no frame where one should start")
    run = np.searchsorted(starts, at, "right") - 1
    wrong = np.unique(run[~_whole(padded, at, np.minimum(np.append(at[1:], ends[-1]), ends[run]))])
    if len(wrong):  # damage, or samples that look like a header
        kept = [at[~np.isin(run, wrong)]]
        for r in wrong.tolist():
            kept.append(_chain(padded, at[run == r], number[run == r], int(ends[r])))
        at = np.sort(np.concatenate(kept))
        run = np.searchsorted(starts, at, "right") - 1
    stop = np.minimum(np.append(at[1:], ends[-1]), ends[run])
    _, found = _headers(padded, at)
    found.ends = stop
    return found


def _decoded(data: np.ndarray, f: Frames) -> np.ndarray:
    """The samples of the frames, end to end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    signed = padded.view(np.int8)
    kind = padded[f.subframes].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("wasted bits are not read")
    kind >>= 1
    fixed, lpc = (kind >= 8) & (kind < 8 + len(FIXED)), kind >= 32
    if not (fixed | lpc | (kind < 2)).all():
        raise ValueError("a subframe of an unknown type")
    words = np.zeros(len(data) + 8, np.uint64)  # the eight bytes from each place on
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    tall = int(f.sizes.max())
    s = np.zeros((tall, len(f.starts)), np.int8)
    stop = f.subframes + np.where(kind == 0, 2, 1 + f.sizes)
    if (stop[kind < 2] + 2 != f.ends[kind < 2]).any():
        raise ValueError("a frame does not end where its samples do")
    s[:, kind == 0] = signed[f.subframes[kind == 0] + 1]
    plain = np.flatnonzero(kind == 1)
    if len(plain):
        s[:, plain] = signed[np.minimum((f.subframes[plain] + 1)[None, :] + np.arange(tall)[:, None], len(signed) - 1)]
    for lanes in (np.flatnonzero(fixed), np.flatnonzero(lpc)):
        if len(lanes):
            order = kind[lanes] - (8 if fixed[lanes[0]] else 31)
            s[:, lanes] = _predicted(words, signed, 8 * len(data), f.subframes[lanes] + 1, f.ends[lanes] - 2, f.sizes[lanes], order, bool(lpc[lanes[0]]))
    return s.T[np.arange(tall) < f.sizes[:, None]]


def _predicted(words: np.ndarray, signed: np.ndarray, least: int, warm: np.ndarray, ends: np.ndarray, size: np.ndarray, order: np.ndarray, lpc: bool) -> np.ndarray:
    """Samples (one column a frame) of predicted subframes of one sort, all frames in step."""
    lanes, sixty_four = np.arange(len(warm)), np.uint64(64)

    def window(bit: np.ndarray) -> np.ndarray:
        bit = np.minimum(bit, least)
        return words[bit >> 3] << (bit & 7).astype(np.uint64)

    bit = 8 * (warm + order)
    most = int(order.max(initial=0))
    shift = np.zeros(len(warm), np.int64)
    if lpc:
        precision = (window(bit) >> np.uint64(60)).astype(np.int64) + 1
        shift = (window(bit + 4) >> np.uint64(59)).astype(np.int64)
        if (precision == 16).any() or (shift > 15).any():
            raise ValueError("a linear predictor that the format forbids")
        bit += 9
        taps = np.zeros((most, len(warm)), np.int64)
        for j in range(most):
            value = (window(bit) >> (sixty_four - precision.astype(np.uint64))).astype(np.int64)
            taps[j] = np.where(j < order, value - ((value >> precision - 1) << precision), 0)
            bit += np.where(j < order, precision, 0)
    else:
        taps = FIXED[order].T
    head = window(bit)
    coding, level = (head >> np.uint64(62)).astype(np.int64), (head >> np.uint64(58)).astype(np.int64) & 15
    part = size >> level
    if (coding > 1).any() or (part << level != size).any() or (part < np.maximum(order, 1)).any():
        raise ValueError("a residual coding that the format forbids")
    bit += 6
    width = 4 + coding
    tall = int(size.max())
    marks = {t for p in np.unique(part).tolist() for t in range(0, tall, p)}
    k, escaped = np.zeros(len(warm), np.int64), np.zeros(len(warm), bool)
    down, none = np.full(len(warm), sixty_four - np.uint64(1)), np.ones(len(warm), bool)
    own = np.zeros((tall, len(warm)), np.int64)
    for t in range(tall):
        if t in marks:
            at = lanes[(t % part == 0) & (t < size)]
            k[at] = (window(bit[at]) >> (sixty_four - width[at].astype(np.uint64))).astype(np.int64)
            bit[at] += width[at]
            escaped[at] = k[at] == (1 << width[at]) - 1
            raw = at[escaped[at]]
            k[raw] = (window(bit[raw]) >> np.uint64(59)).astype(np.int64)
            bit[raw] += 5
            down, none = sixty_four - np.maximum(k, 1).astype(np.uint64), k == 0
            some = escaped.any()
        busy = (t >= order) & (t < size)
        run = ZEROS16[(window(bit) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        if some:
            run[escaped] = 0
        zeros = run.copy()
        more = np.flatnonzero((run == 16) & busy)
        while len(more):
            place = bit[more] + zeros[more]
            if (place > least).any():
                raise ValueError("a frame ends early")
            run = ZEROS16[(window(place) >> np.uint64(48)).astype(np.int64)].astype(np.int64)
            zeros[more] += run
            more = more[run == 16]
        after = bit + zeros + 1
        if some:
            after[escaped] -= 1
        low = np.where(none, np.uint64(0), window(after) >> down).astype(np.int64)
        u = zeros << k | low
        value = (u >> 1) ^ -(u & 1)
        if some:
            value = np.where(escaped, np.where(none, 0, low - ((low >> np.maximum(k - 1, 0)) << k)), value)
        if most and t:
            guess = taps[0] * own[t - 1]
            for j in range(1, min(t, most)):
                guess += taps[j] * own[t - 1 - j]
            value += guess >> shift if lpc else guess
        if busy.all():
            own[t], bit = value, after + k
        else:
            own[t] = np.where(busy, value, signed[np.minimum(warm + t, len(signed) - 1)])
            bit = np.where(busy, after + k, bit)
    if ((bit + 7) >> 3 != ends).any():
        raise ValueError("a frame does not end where its samples do")
    if (np.abs(2 * own + 1) > 255).any():
        raise ValueError("a sample of more than 8 bits")
    return own.astype(np.int8)


@dataclass
class Pcm:
    """Blocks of samples, each from a seek point to the next: stream, first sample, offset in the stream, and the samples end to end."""

    stream: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    stops: np.ndarray
    samples: np.ndarray


def blocks(streams: list[bytes], seekable: bool = True) -> Iterator[Pcm]:
    """The blocks of all streams in order, about RUN frames at a time; every checksum and every number in the metadata is verified."""
    runs: list[tuple[int, Stream, int, int, int]] = []  # stream, its facts, place of the seek point, bytes
    sums: dict[int, list] = {}
    held = 0

    def read() -> Pcm:
        sizes = np.array([b - a for *_, a, b in runs])
        ends = np.cumsum(sizes)
        data = np.concatenate([s.data[a:b] for _, s, _, a, b in runs])
        f = _found(data, ends - sizes, ends)
        samples = _decoded(data, f)
        cut = np.searchsorted(f.starts, ends)  # frames before the end of each run
        stops = np.cumsum(f.sizes)[cut - 1]
        first = []
        for (k, s, p, a, b), x, y, stop in zip(runs, np.append(0, cut[:-1]).tolist(), cut.tolist(), stops.tolist()):
            at, point = sums.setdefault(k, [0, hashlib.md5(), 1 << 24, 0]), s.points[p]
            own = f.sizes[x:y]
            final = p == len(s.points) - 1
            bytes_ = f.ends[x:y] - f.starts[x:y]
            whole = own if not final else own[:-1]
            if int(point["sample"]) != at[0] or int(point["samples"]) != own[0] or (f.numbers[x:y] != at[0] // s.most + np.arange(y - x)).any():
                raise ValueError("a seek point or a frame's number differs")
            if (whole != s.most).any() or s.least != s.most or own[-1] > s.most or (f.rates[x:y] * (f.rates[x:y] != s.rate)).any():
                raise ValueError("a frame differs from the stream's facts")
            first.append(at[0])
            at[0] += int(own.sum())
            at[1].update(samples[stop - int(own.sum()) : stop])
            at[2], at[3] = min(at[2], int(bytes_.min())), max(at[3], int(bytes_.max()))
            if final:
                total, digest, low, high = sums.pop(k)
                if total != s.total or digest.digest() != s.digest or s.smallest not in (0, low) or s.largest not in (0, high):
                    raise ValueError("a stream's MD5, length or frame sizes differ")
        got = Pcm(np.array([k for k, *_ in runs]), np.array(first), np.array([a for *_, a, _ in runs]), stops, samples)
        runs.clear()
        return got

    try:
        for k, stream in enumerate(streams):
            s = _parsed(stream, seekable)
            edges = np.append(s.points["offset"].astype(np.int64) + s.frames, len(stream)).tolist()
            due = np.diff(np.append(s.points["sample"].astype(np.int64), s.total)) // max(1, s.most)
            for p, (a, b) in enumerate(zip(edges, edges[1:])):
                runs.append((k, s, p, a, b))
                held += max(1, int(due[p]))
                if held >= RUN:
                    yield read()
                    held = 0
        if runs:
            yield read()
    except (IndexError, OverflowError, ZeroDivisionError) as error:
        raise ValueError("a damaged stream") from error


def decode(streams: list[bytes], seekable: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes end to end and their sizes."""
    parts, sizes = [], np.zeros(len(streams), np.int64)
    for b in blocks(streams, seekable):
        parts.append(b.samples.view(np.uint8) ^ np.uint8(128))
        np.add.at(sizes, b.stream, np.diff(np.append(0, b.stops)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8), sizes


# --- columns ---------------------------------------------------------------------------------------------------------


def padded_payloads(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payloads end to end, their sizes, and the sizes without the padding."""
    data, offsets = text_bytes(column)
    plain = np.diff(offsets)
    sizes = np.maximum(1, -(-plain // PAD)) * PAD
    out = np.full(int(sizes.sum()), 32, np.uint8)
    for to, a, b in zip((np.cumsum(sizes) - sizes).tolist(), offsets.tolist(), offsets[1:].tolist()):
        out[to : to + b - a] = data[a:b]
    return out, sizes, plain


class Summary:
    """Sums over the blocks of one stream: payload digest, last bytes, loudness, range, crossings of each block's mean and the loudest block."""

    def __init__(self) -> None:
        self.sha, self.tail, self.n, self.total, self.energy = hashlib.sha256(), b"", 0, 0, 0
        self.low, self.high, self.crossings, self.peak = 127, -128, 0, (-1.0, 0)

    def add(self, first: int, pcm: np.ndarray, total: int, energy: int, low: int, high: int, crossings: int) -> None:
        payload = (pcm.view(np.uint8) ^ np.uint8(128)).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload[-16:])[-16:]
        self.n, self.total, self.energy = self.n + len(pcm), self.total + total, self.energy + energy
        self.low, self.high = min(self.low, low), max(self.high, high)
        self.crossings += crossings
        if energy / len(pcm) > self.peak[0]:
            self.peak = energy / len(pcm), first

    def feature(self) -> str:
        """From exact sums, so equal samples give equal text."""
        return f"rms={(self.energy / self.n) ** 0.5:.4f};mean={self.total / self.n:.4f};crossings={self.crossings};low={self.low};high={self.high};loudest={self.peak[1]}"


def summaries(streams: list[bytes]) -> list[Summary]:
    found = [Summary() for _ in streams]
    for b in blocks(streams):
        starts = np.append(0, b.stops[:-1])
        wide = b.samples.astype(np.int64)
        size, total = np.diff(np.append(starts, len(wide))), np.add.reduceat(wide, starts)
        above = wide * np.repeat(size, size) > np.repeat(total, size)
        turns = np.zeros(len(wide), np.int64)
        turns[1:] = above[1:] != above[:-1]
        turns[starts] = 0
        sums = [total.tolist(), *(np.add.reduceat(x, starts).tolist() for x in (wide * wide, turns))]
        low, high = np.minimum.reduceat(b.samples, starts).tolist(), np.maximum.reduceat(b.samples, starts).tolist()
        for i, (k, first, x, y) in enumerate(zip(b.stream.tolist(), b.first.tolist(), starts.tolist(), b.stops.tolist())):
            found[k].add(first, b.samples[x:y], sums[0][i], sums[1][i], low[i], high[i], sums[2][i])
    return found


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Stores each text as a FLAC stream, reads its PCM blocks back from seek point to seek point, and returns sizes, checksums and features of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                payload, sizes, plain = padded_payloads(batch.column(1))
                streams = encode(payload, sizes)
                read = summaries(streams)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(plain, pa.int64()), pa.array([x.n for x in read], pa.int64()),
                        pa.array([x.sha.hexdigest() for x in read], pa.string()),
                        pa.array([zlib.crc32(x.tail) for x in read], pa.int64()),
                        pa.array([len(x) for x in streams], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string()),
                        pa.array([x.feature() for x in read], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, shape)


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and media: the FLAC stream of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                payload, sizes, _ = padded_payloads(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(payload, sizes), pa.binary())], ["doc_id", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, first_sample, stream_offset and pcm of the streams' blocks, from seek point to seek point. Null media have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media"):
                held = batch.filter(batch.column(1).is_valid())
                for b in blocks(held.column(1).to_pylist()):
                    pcm = [b.samples[x:y].tobytes() for x, y in zip(np.append(0, b.stops[:-1]).tolist(), b.stops.tolist())]
                    yield pa.RecordBatch.from_arrays([held.column(0).take(pa.array(b.stream)), pa.array(b.first, pa.int64()), pa.array(b.offset, pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "first_sample", "stream_offset", "pcm"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, first_sample bigint, stream_offset bigint, pcm binary")
