"""FLAC media columns: lossless storage of byte payloads as 8-bit mono audio, and the decoder that reads them back.

Frames are independent, so numpy works on thousands of them at once, one lane each: the Rice decoder takes the j-th
residual of all lanes in one step, the checksums take the j-th byte of all lanes. Every frame has a seek point, so a
reader can start at any block. The decoder checks the marker, both checksums of every frame and the MD5 of the samples,
and raises ValueError when one fails.

Null text is the empty text; its payload is one block of padding. Rows are independent, and equal texts give equal
files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillstone.llm.common import texts_of

BLOCK = 576
RATE = 8000
#: Lanes worked on at once: bounds memory, not results.
LANES = 4096


def _table(poly: int, bits: int) -> np.ndarray:
    """Checksum of each byte value, most significant bit first."""
    value = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, value << 1 ^ poly, value << 1) & ((1 << bits) - 1)
    return value


# Fixed values of the format: generator polynomials x^8+x^2+x+1 and x^16+x^15+x^2+1.
CRC8 = _table(0x07, 8)
CRC16 = _table(0x8005, 16)
_LEADING = np.full(1 << 16, 16, np.uint8)
for _n in range(15, -1, -1):
    _LEADING[1 << (15 - _n) : 1 << (16 - _n)] = _n


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Checksums of data[start : start + size] of every lane."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.zeros(len(order), np.uint32)
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for j, n in enumerate(live.tolist()):  # lanes of at least j + 1 bytes
        c = crc[:n]
        crc[:n] = (c << 8 & ((1 << bits) - 1)) ^ table[(c >> (bits - 8)) ^ data[at[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """Frame number in the format's extension of UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = next(c for c in range(1, 7) if n < 1 << (5 * c + 6))
    return bytes([0xFF << (7 - more) & 0xFF | n >> 6 * more, *(0x80 | n >> 6 * j & 0x3F for j in range(more - 1, -1, -1))])


def _fixed_residuals(x: np.ndarray, order: int) -> np.ndarray:
    r = x
    for _ in range(order):
        r = np.diff(r, axis=1)
    return r


def _encode_lanes(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of blocks x (lanes, BLOCK), with these frame numbers."""
    lanes = len(x)
    orders = (0, 1, 2)
    residuals = [_fixed_residuals(x, o) for o in orders]
    order = np.stack([np.abs(r[:, 2 - o :]).sum(axis=1) for o, r in zip(orders, residuals, strict=True)]).argmin(axis=0)
    n_res = BLOCK - order
    u = np.zeros((lanes, BLOCK), np.int64)  # folded residuals, the warm-up's places left out
    for o in orders:
        pick = np.flatnonzero(order == o)
        r = residuals[o][pick].astype(np.int64)
        u[pick, o:] = r << 1 ^ r >> 63
    used = np.arange(BLOCK)[None, :] >= order[:, None]
    guess = np.log2(np.maximum(u.sum(axis=1) / n_res, 1)).astype(np.int64)
    trial = np.clip(guess[None, :] + np.arange(-1, 2)[:, None], 0, 14)
    cost = np.stack([((u >> k[:, None]) * used).sum(axis=1) + n_res * (1 + k) for k in trial])
    best = cost.argmin(axis=0)
    k = trial[best, np.arange(lanes)]
    rice_bits = 8 + 8 * order + 10 + cost[best, np.arange(lanes)]
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (rice_bits >= 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    body = np.where(constant, 2, np.where(verbatim, 1 + BLOCK, (rice_bits + 7) // 8))
    heads = []
    for i, number in enumerate(numbers.tolist()):
        h = bytes([0xFF, 0xF8, 0x24, 0x02]) + _number(number)  # block code 2 (576), rate code 4 (8 kHz), mono, 8 bits
        heads.append(h)
    head_size = np.array([len(h) for h in heads]) + 1
    size = head_size + body + 2
    start = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_start = np.cumsum(head_size - 1) - (head_size - 1)
    data[np.repeat(start - head_start, head_size - 1) + np.arange(len(head_data))] = head_data
    data[start + head_size - 1] = _crc(data, start, head_size - 1, CRC8, 8)
    at = start + head_size
    c = np.flatnonzero(constant)
    data[at[c] + 1] = x[c, 0].astype(np.int8).view(np.uint8)
    v = np.flatnonzero(verbatim)
    data[at[v]] = 0x02
    data[at[v][:, None] + 1 + np.arange(BLOCK)] = x[v].astype(np.int8).view(np.uint8)
    r = np.flatnonzero(rice)
    if len(r):
        bits = np.zeros(len(data) * 8, np.uint8)
        pos = at[r] * 8

        def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
            for t in range(width):
                bits[pos + t] = value >> (width - 1 - t) & 1

        put(pos, (8 + order[r]) << 1, 8)
        for o in orders[1:]:
            w = r[order[r] == o]
            for j in range(o):
                put(at[w] * 8 + 8 + 8 * j, x[w, j].astype(np.int64) & 0xFF, 8)
        put(pos + 8 + 8 * order[r], k[r], 10)  # method 0, one partition, its parameter
        mask = used[r]
        kk = np.broadcast_to(k[r][:, None], mask.shape)[mask]
        uu = u[r][mask]
        width = (uu >> kk) + 1 + kk
        ends = np.cumsum(width)
        lane_total = np.bincount(np.repeat(np.arange(len(r)), mask.sum(axis=1)), width, len(r)).astype(np.int64)
        lane_before = np.cumsum(lane_total) - lane_total
        p = ends - width + np.repeat(pos + 18 + 8 * order[r] - lane_before, mask.sum(axis=1)) + (uu >> kk)
        bits[p] = 1
        for t in range(int(k[r].max())):
            w = kk > t
            bits[(p + kk - t)[w]] = (uu >> t & 1)[w]
        data |= np.packbits(bits)
    crc = _crc(data, start, size - 2, CRC16, 16)
    data[start + size - 2], data[start + size - 1] = crc >> 8, crc & 0xFF
    raw = data.tobytes()
    return [raw[s : s + n] for s, n in zip(start.tolist(), size.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC files of payloads whose sizes are positive multiples of the block."""
    if any(len(p) == 0 or len(p) % BLOCK for p in payloads):
        raise ValueError(f"payloads must be positive multiples of {BLOCK} bytes")
    blocks = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(n) for n in blocks]) if blocks else np.zeros(0, np.int64)
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    frames: list[bytes] = []
    for i in range(0, len(joined), LANES):
        frames += _encode_lanes((joined[i : i + LANES] ^ 0x80).view(np.int8).astype(np.int32), numbers[i : i + LANES])
    out, at = [], 0
    for payload, n in zip(payloads, blocks, strict=True):
        own = frames[at : at + n]
        at += n
        sizes = [len(f) for f in own]
        pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points = np.zeros(n, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        points["sample"] = np.arange(n) * BLOCK
        points["offset"] = np.cumsum(sizes) - sizes
        points["count"] = BLOCK
        tables = [points[i : i + 900_000].tobytes() for i in range(0, n, 900_000)]  # a metadata block holds 24 bits of length
        meta = b"\x00" + len(info).to_bytes(3, "big") + info
        for i, t in enumerate(tables):
            meta += bytes([(0x80 if i == len(tables) - 1 else 0) | 3]) + len(t).to_bytes(3, "big") + t
        out.append(b"fLaC" + meta + b"".join(own))
    return out


class _Bits:
    """A bit position for each lane in one buffer."""

    def __init__(self, data: np.ndarray, pos: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
        self.pos = pos

    def window(self) -> np.ndarray:
        """The next 57 bits at least, at the top of a word."""
        at = np.minimum(self.pos >> 3, len(self.words) - 1)
        return self.words[at].astype(np.uint64) << (self.pos & 7).astype(np.uint64)

    def read(self, width: int | np.ndarray) -> np.ndarray:
        w = np.broadcast_to(np.asarray(width, np.uint64), self.pos.shape)
        value = np.where(w > 0, self.window() >> np.minimum(np.uint64(64) - w, np.uint64(63)), np.uint64(0))
        self.pos = self.pos + w.astype(np.int64)
        return value.astype(np.int64)

    def signed(self, width: int | np.ndarray) -> np.ndarray:
        value, half = self.read(width), np.left_shift(1, np.maximum(np.asarray(width, np.int64) - 1, 0))
        return np.where(value >= half, value - 2 * half, value)

    def rice(self, k: np.ndarray) -> np.ndarray:
        """One Rice-coded residual of each lane."""
        window = self.window()
        q = _LEADING[window >> np.uint64(48)].astype(np.int64)
        if (q == 16).any():  # a long unary part: walk on in the lanes that have one
            far = np.flatnonzero(q == 16)
            self.pos[far] += 16
            while len(far):
                lane = _Bits.__new__(_Bits)
                lane.words, lane.pos = self.words, self.pos[far]
                if (lane.pos >> 3 >= len(self.words)).any():
                    raise ValueError("residual runs past the end")
                more = _LEADING[lane.window() >> np.uint64(48)].astype(np.int64)
                q[far] += more
                self.pos[far] += np.where(more == 16, 16, 0)
                far = far[more == 16]
            self.pos -= np.where(q >= 16, q // 16 * 16, 0)  # as if nothing had been walked
            self.pos += q + 1
            u = q << k | self.read(k)
        else:
            kk = k.astype(np.uint64)
            low = window << (q + 1).astype(np.uint64) >> np.uint64(1) >> (np.uint64(63) - kk)
            u = q << k | low.astype(np.int64)
            self.pos = self.pos + (q + 1 + k)
        return u >> 1 ^ -(u & 1)


def _residuals(bits: _Bits, n: int, order: np.ndarray) -> np.ndarray:
    """(lanes, n) residuals; the warm-up's places stay zero."""
    method = bits.read(2)
    if (method > 1).any():
        raise ValueError("unknown residual coding")
    parts = bits.read(4)
    length = n >> parts
    out = np.zeros((len(order), n), np.int64)
    k = np.zeros(len(order), np.int64)
    raw = np.full(len(order), -1, np.int64)
    starts = np.zeros((len(order), n), bool) if parts.any() else None
    if starts is not None:
        starts[:, 1:] = np.arange(1, n)[None, :] % length[:, None] == 0
    for j in range(n):
        live = None if j >= 32 else order <= j
        fresh = (order == j) if starts is None else (starts[:, j] & (order <= j)) | (order == j)
        if (j < 33 or starts is not None) and fresh.any():
            lane = _Bits.__new__(_Bits)
            where = np.flatnonzero(fresh)
            lane.words, lane.pos = bits.words, bits.pos[where]
            wide = method[where] + 4
            p = lane.read(wide)
            escape = p == (1 << wide) - 1
            width = lane.read(np.where(escape, 5, 0))
            k[where], raw[where] = np.where(escape, 0, p), np.where(escape, width, -1)
            bits.pos[where] = lane.pos
        odd = (raw >= 0).any() or (live is not None and not live.all())
        if not odd:
            out[:, j] = bits.rice(k)
            continue
        for where, plain in ((np.flatnonzero((raw < 0) & (live if live is not None else True)), True), (np.flatnonzero((raw >= 0) & (live if live is not None else True)), False)):
            if len(where):
                lane = _Bits.__new__(_Bits)
                lane.words, lane.pos = bits.words, bits.pos[where]
                out[where, j] = lane.rice(k[where]) if plain else lane.signed(raw[where])
                bits.pos[where] = lane.pos
    return out


def _restore_fixed(x: np.ndarray, order: int) -> np.ndarray:
    """Integrate residuals `order` times; x holds the warm-up samples in its first places."""
    levels = [x[:, :order]]
    for _ in range(order):
        levels.append(np.diff(levels[-1], axis=1))
    out = x.copy()
    for j in range(order - 1, -1, -1):
        out[:, j] = levels[j][:, 0]
        np.cumsum(out[:, j:], axis=1, out=out[:, j:])
    return out


def _decode_lanes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples, frame numbers and ends of the frames that begin at these bytes, all of the same block size."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    head = padded[start[:, None] + np.arange(4)].astype(np.int64)
    if not ((head[:, 0] == 0xFF) & (head[:, 1] == 0xF8)).all():
        raise ValueError("no frame begins here")
    code = head[:, 2] >> 4
    if (head[:, 3] != 0x02).any() or (code != code[0]).any() or code[0] not in (*range(1, 6), *range(8, 16)):
        raise ValueError("only mono 8-bit frames of one common block size are read")
    n = int(192 if code[0] == 1 else 576 << (code[0] - 2) if code[0] < 6 else 256 << (code[0] - 8))
    lead = padded[start + 4].astype(np.int64)
    more = np.where(lead < 0x80, 0, _LEADING[(~lead & 0xFF) << 8].astype(np.int64) - 1)
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
    for j in range(1, int(more.max(initial=0)) + 1):
        number = np.where(more >= j, number << 6 | padded[start + 4 + j] & 0x3F, number)
    size = 5 + more
    if (_crc(padded, start, size, CRC8, 8) != padded[start + size]).any():
        raise ValueError("a frame header's checksum is wrong")
    at = start + size + 1
    kind = padded[at].astype(np.int64)
    if (kind & 0x81).any():
        raise ValueError("wasted bits and padding bits are not read")
    kind >>= 1
    out = np.zeros((len(start), n), np.int64)
    end = np.zeros(len(start), np.int64)
    c = np.flatnonzero(kind == 0)
    out[c] = padded[at[c] + 1].view(np.int8)[:, None]
    end[c] = at[c] + 2
    v = np.flatnonzero(kind == 1)
    out[v] = padded[at[v][:, None] + 1 + np.arange(n)].view(np.int8)
    end[v] = at[v] + 1 + n
    linear = np.flatnonzero(kind >= 8)
    if len(c) + len(v) + len(linear) != len(start) or ((kind > 12) & (kind < 32)).any():
        raise ValueError("unknown subframe")
    if len(linear):
        t = kind[linear]
        order = np.where(t >= 32, t - 31, t - 8)
        bits = _Bits(data, (at[linear] + 1) * 8)
        warm = np.zeros((len(linear), 32), np.int64)
        weights = np.zeros((len(linear), 32), np.int64)
        shift = np.zeros(len(linear), np.int64)
        for j in range(int(order.max())):
            width = np.where(order > j, 8, 0)
            warm[:, j] = np.where(order > j, bits.signed(width), 0)
        lpc = t >= 32
        if lpc.any():
            precision = bits.read(np.where(lpc, 4, 0)) + 1
            shift = np.where(lpc, bits.signed(np.where(lpc, 5, 0)), 0)
            for j in range(int(order[lpc].max())):
                use = lpc & (order > j)
                weights[:, j] = np.where(use, bits.signed(np.where(use, precision, 0)), 0)
        residual = _residuals(bits, n, order)
        for o in np.unique(order[~lpc]):
            pick = np.flatnonzero(~lpc & (order == o))
            x = residual[pick]
            x[:, :o] = warm[pick, :o]
            out[linear[pick]] = _restore_fixed(x, int(o))
        for o in np.unique(order[lpc]):
            pick = np.flatnonzero(lpc & (order == o))
            x = residual[pick]
            x[:, :o] = warm[pick, :o]
            for j in range(int(o), n):
                x[:, j] += (x[:, j - o : j][:, ::-1] * weights[pick, :o]).sum(axis=1) >> shift[pick]
            out[linear[pick]] = x
        end[linear] = (bits.pos + 7) >> 3
    stored = padded[end].astype(np.int64) << 8 | padded[end + 1]
    if (_crc(padded, start, end - start, CRC16, 16) != stored).any():
        raise ValueError("a frame's checksum is wrong")
    return out, number, end + 2


def _container(media: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Total samples, first frame's byte, MD5 and seek points (sample, byte from the first frame)."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC file")
    at, total, md5, points, last = 4, 0, b"", [], False
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(block[10:18], "big") & (1 << 36) - 1, block[18:34]
        elif kind == 3:
            table = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            table = table[table["sample"] != 2**64 - 1]
            points += list(zip(table["sample"].tolist(), table["offset"].tolist(), strict=True))
        at += 4 + size
    return total, at, md5, points


def decode(files: list[bytes], first: int = 0, count: int | None = None) -> list[bytes]:
    """Payload bytes of each file. With first and count (samples), only the blocks that hold them are read: the seek
    points give their places. Frames without a seek point are reached from the one before."""
    buffer = np.frombuffer(b"".join(files), np.uint8)
    lane_file, lane_sample, lane_at, meta = [], [], [], []
    at = 0
    for i, media in enumerate(files):
        total, head, md5, points = _container(media)
        stop = total if count is None else min(total, first + count)
        points = points or [(0, 0)]
        samples = [s for s, _ in points] + [total]
        for (s, o), nxt in zip(points, samples[1:], strict=True):
            if nxt > first and s < stop:
                lane_file.append(i)
                lane_sample.append((s, nxt))
                lane_at.append(at + head + o)
        meta.append((total, md5, stop))
        at += len(media)
    parts: list[dict[int, bytes]] = [{} for _ in files]
    where = np.array(lane_at, np.int64)
    spans = np.array(lane_sample, np.int64).reshape(-1, 2)
    owner = np.array(lane_file, np.int64)
    while len(where):
        ends, sizes = [], []
        for i in range(0, len(where), LANES):
            x, _, end = _decode_lanes(buffer, where[i : i + LANES])
            ends.append(end)
            sizes.append(np.full(len(end), x.shape[1]))
            raw = (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
            n = x.shape[1]
            for j, (f, s) in enumerate(zip(owner[i : i + LANES].tolist(), spans[i : i + LANES, 0].tolist(), strict=True)):
                parts[f][s] = raw[j * n : (j + 1) * n]
        where = np.concatenate(ends)
        spans[:, 0] += np.concatenate(sizes)
        go = spans[:, 0] < spans[:, 1]
        where, spans, owner = where[go], spans[go], owner[go]
    out = []
    for (total, md5, stop), blocks in zip(meta, parts, strict=True):
        order = sorted(blocks)
        payload = b"".join(blocks[s] for s in order)
        if count is None and first == 0:
            pcm = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
            if len(payload) != total or (any(md5) and hashlib.md5(pcm).digest() != md5):
                raise ValueError("the samples' MD5 is wrong")
            out.append(payload)
        else:
            skip = first - order[0] if order else 0
            out.append(payload[skip : skip + max(0, stop - first)])
    return out


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of the text, with bytes 255 up to a positive multiple of the block."""
    b = (text or "").encode()
    return b + b"\xff" * (-len(b) % BLOCK if b else BLOCK)


def features(data: bytes) -> str:
    """Whole-number features of the samples read back."""
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(np.abs(x).max())};crossings={crossings}"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text as a FLAC file."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = texts_of(batch.column(1))
            media = encode([payload(t) for t in texts])
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", samples: int = 16 * BLOCK) -> DataFrame:
    """(id, first_sample, n_samples, pcm binary): the files' samples in blocks that can be sought by first_sample."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            row, first, data = [], [], []
            for i, whole in enumerate(decode([m for m in batch.column(1).to_pylist()])):
                for s in range(0, len(whole), samples):
                    row.append(i)
                    first.append(s)
                    data.append(whole[s : s + samples])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(first, pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())],
                ["id", "first_sample", "n_samples", "pcm"],
            )

    rows = media.where(media[media_col].isNotNull()).select(media[id_col].alias("id"), media[media_col].alias("m"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, first_sample long, n_samples long, pcm binary")
    return out.withColumnRenamed("id", id_col)


def stored_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text's FLAC file and of the payload read back from it, in one pass over the rows."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = texts_of(batch.column(1))
            media = encode([payload(t) for t in texts])
            back = decode(media)
            sha = lambda items: pa.array([hashlib.sha256(b).hexdigest() for b in items], pa.string())
            whole = lambda items: pa.array(items, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), whole([len(t.encode()) for t in texts]), whole([len(b) for b in back]), sha(back),
                    whole([zlib.crc32(b[-32:]) for b in back]), whole([len(m) for m in media]), sha(media), pa.array([features(b) for b in back], pa.string()),
                ],
                names,
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
