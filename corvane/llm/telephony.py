"""Telephony audio columns: G.711 mu-law and A-law, IMA ADPCM blocks, WAVE containers, resampling."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PCM, A_LAW, MU_LAW, IMA_ADPCM, EXTENSIBLE = 1, 6, 7, 0x11, 0xFFFE
UNIT = 64
#: Bytes of media that a task handles at once, or one longer file.
LOT = 1 << 21


def mu_law_table() -> np.ndarray:
    """int16 value of each mu-law code, by the rule of G.711."""
    u = ~np.arange(256, dtype=np.int64) & 0xFF
    x = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -x, x).astype(np.int16)


def a_law_table() -> np.ndarray:
    """int16 value of each A-law code, by the rule of G.711."""
    a = np.arange(256, dtype=np.int64) ^ 0x55
    e, m = (a & 0x70) >> 4, (a & 0x0F) << 4
    x = np.where(e == 0, m + 8, (m + 0x108) << np.maximum(e - 1, 0))
    return np.where(a & 0x80, x, -x).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 IMA step sizes: each about 1.1 times the one before (fixed values)."""
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int64)


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int64)


def encode_law(pcm: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The code of the nearest value in a G.711 table, for each int16 sample."""
    order = np.argsort(table, kind="stable")
    values = table[order].astype(np.int64)
    at = np.clip(np.searchsorted(values, pcm), 1, 255)
    near = np.where(pcm.astype(np.int64) - values[at - 1] <= values[at] - pcm, at - 1, at)
    return order[near].astype(np.uint8)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM: all blocks step by step together, a short last block by itself."""
    whole, rest = divmod(len(data), block)
    out = [_ima_blocks(np.frombuffer(data, np.uint8, whole * block).reshape(whole, block)).ravel()] if whole else []
    if rest >= 4:
        out.append(_ima_blocks(np.frombuffer(data, np.uint8, rest, whole * block).reshape(1, rest)).ravel())
    return np.concatenate(out) if out else np.empty(0, np.int16)


def _ima_blocks(b: np.ndarray) -> np.ndarray:
    value = np.ascontiguousarray(b[:, :2]).view("<i2")[:, 0].astype(np.int64)
    index = np.clip(b[:, 2].astype(np.int64), 0, 88)
    codes = np.stack([b[:, 4:] & 15, b[:, 4:] >> 4], axis=2).reshape(len(b), -1)
    out = np.empty((len(b), codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        c, step = codes[:, k].astype(np.int64), STEPS[index]
        move = (step >> 3) + np.where(c & 1, step >> 2, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 4, step, 0)
        value = np.clip(np.where(c & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX[c & 7], 0, 88)
        out[:, k + 1] = value
    return out


def encode_ima(texts: list[np.ndarray], block: int = 256) -> bytes:
    """Mono IMA ADPCM of int16 samples, one series after the other, each in blocks of its own, the last filled up with its last sample. All blocks step by step together."""
    per = (block - 4) * 2 + 1
    filled = [np.concatenate([x, np.full(-len(x) % per if len(x) else per, x[-1] if len(x) else 0, np.int16)]) for x in texts]
    x = np.concatenate(filled).astype(np.int64).reshape(-1, per) if filled else np.empty((0, per), np.int64)
    n = len(x)
    # each block starts at the step size that its first move needs
    value, index = x[:, 0].copy(), np.clip(np.searchsorted(STEPS, np.abs(x[:, 1] - x[:, 0])), 0, 88)
    out = np.zeros((n, block), np.uint8)
    out[:, 2] = index
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        step, gap = STEPS[index], x[:, k] - value
        c, left = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit, size in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = left >= size
            c, left = c | np.where(take, bit, 0), np.where(take, left - size, left)
        move = (step >> 3) + np.where(c & 1, step >> 2, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 4, step, 0)
        value = np.clip(np.where(c & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX[c & 7], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (c << (4 * ((k - 1) & 1))).astype(np.uint8)
    return out.tobytes()


def wave(data: bytes, form: int = MU_LAW, rate: int = 8000, block: int = 256) -> bytes:
    """A WAVE file of mono samples; data of odd length is padded in the container only."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(form, 8)
    align = {PCM: 2, IMA_ADPCM: block}.get(form, 1)
    per = (block - 4) * 2 + 1
    speed = rate * block // per if form == IMA_ADPCM else rate * align
    extra = struct.pack("<HH", 2, per) if form == IMA_ADPCM else struct.pack("<H", 0) if form != PCM else b""
    fmt = struct.pack("<HHIIHH", form, 1, rate, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, int, int, bytes]:
    """(form, channels, rate, block, bits, data) of a WAVE file; unknown chunks are passed over, the extensible form gives the form inside. What is no such file is a ValueError."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        size = struct.unpack_from("<I", media, at + 4)[0]
        if media[at : at + 4] == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("short format chunk")
            form, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if form == EXTENSIBLE and at + 34 <= len(media):
                form = struct.unpack_from("<H", media, at + 32)[0]
        elif media[at : at + 4] == b"data" and form is not None:
            if not channels or not rate:
                raise ValueError("no channels or no rate")
            return form, channels, rate, block, bits, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, int16 samples) of a WAVE file: mu-law, A-law, PCM of 8, 16, 24 or 32 bits, of which the upper 16 stay, or mono IMA ADPCM. Channels are averaged. Any other form is a ValueError."""
    form, channels, rate, block, bits, data = read_wave(media)
    if form in (MU_LAW, A_LAW) and bits == 8:
        x = (MU if form == MU_LAW else A)[np.frombuffer(data, np.uint8)]
    elif form == IMA_ADPCM:
        if channels != 1 or block < 5:
            raise ValueError(f"IMA ADPCM of {channels} channels in blocks of {block}")
        return rate, decode_ima(data, block)
    elif form == PCM and bits == 8:
        x = ((np.frombuffer(data, np.uint8).astype(np.int16) - 128) << 8).astype(np.int16)
    elif form == PCM and bits in (16, 24, 32):
        wide = bits // 8
        x = np.frombuffer(data, np.uint8, len(data) // wide * wide).reshape(-1, wide)[:, -2:].copy().view("<i2")[:, 0]
    else:
        raise ValueError(f"form {form} of {bits} bits")
    if channels > 1:
        x = np.rint(x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)).astype(np.int16)
    return rate, x


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation to another rate, int16; on the way down after a low-pass filter (a windowed sinc) at half the new rate."""
    if rate == to or not len(x):
        return x
    if to == 2 * rate:
        mid = (x.astype(np.int32) + np.append(x[1:], x[-1:]).astype(np.int32)) >> 1
        return np.stack([x, mid.astype(np.int16)], axis=1).ravel()
    y = x.astype(float)
    if to < rate:
        k = np.arange(-(8 * rate // to), 8 * rate // to + 1)
        filter_ = np.sinc(k * to / rate) * np.hanning(len(k) + 2)[1:-1]
        edge = len(k) // 2
        y = np.convolve(np.pad(y, edge, mode="edge"), filter_ / filter_.sum(), "valid")
    at = np.arange(-(-len(x) * to // rate)) * (rate / to)
    return np.clip(np.rint(np.interp(at, np.arange(len(y)), y)), -32768, 32767).astype(np.int16)


def payload(text: bytes) -> bytes:
    """The bytes, with zeros appended up to a positive multiple of 64."""
    return text + b"\0" * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def store_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 payload as the samples of a mu-law WAVE file at 8 kHz.

    Null text counts as empty and is stored as 64 zero bytes; null ids and repeated rows stay. Other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([wave(payload(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return plain.mapInArrow(run, f"id {dict(plain.dtypes)['id']}, n_bytes long, media binary")


def samples(df: DataFrame, media_col: str = "media", rate: int = 16000, out_col: str = "pcm", reason_col: str = "pcm_reason") -> DataFrame:
    """The input with each WAVE column decoded, resampled and stored as a mono PCM WAVE file in ``out_col``; broken media and unknown forms give null there and why in ``reason_col``.

    Null media give null in both. Columns of these two names are replaced; all others, ties and repeated rows pass through.
    """
    kept = [c for c in df.columns if c not in (out_col, reason_col)]
    plain = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, why = [], []
            for m in b.column(at).to_pylist():
                try:
                    have, x = decode(m) if m is not None else (rate, None)
                    out.append(None if x is None else wave(resample(x, have, rate).astype("<i2").tobytes(), PCM, rate))
                    why.append(None)
                except (ValueError, struct.error) as error:
                    out.append(None)
                    why.append(str(error))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary()), pa.array(why, pa.string())], [*kept, out_col, reason_col])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(out_col, T.BinaryType()), T.StructField(reason_col, T.StringType())]))


def feature(pcm: np.ndarray, error: np.ndarray) -> str:
    """Samples, peak, root mean square and zero crossings of the resampled audio, and the mean absolute error that ADPCM leaves, all from integers."""
    wide = pcm.astype(np.int64)
    rms = int(np.sqrt(int(np.dot(wide, wide)) / max(len(pcm), 1)))
    sign = np.signbit(pcm)
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={rms};zc={int(np.count_nonzero(sign[1:] != sign[:-1]))};ima={int(np.abs(error).sum()) // max(len(error), 1)}"


def describe(df: DataFrame, rate: int = 16000, block: int = 256) -> DataFrame:
    """Digest of stored media (id, n_bytes, media), all read back from the stored bytes.

    The codes are expanded by the mu-law table, resampled and stored as PCM; they are also stored as IMA ADPCM, whose blocks, those of many texts together, are decoded again. ``feature`` tells of both.
    Null ids and repeated rows stay; other columns are not carried.
    """
    per = (block - 4) * 2 + 1

    def lots(media: list[bytes]) -> Iterator[tuple[int, int]]:
        low = size = 0
        for i, m in enumerate(media):
            size += len(m)
            if size > LOT:
                yield low, i + 1
                low, size = i + 1, 0
        if low < len(media):
            yield low, len(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in lots(b.column(2).to_pylist()):
                part = b.slice(low, high - low)
                media = part.column(2).to_pylist()
                data = [read_wave(m)[5] for m in media]
                speech = [decode(m)[1] for m in media]
                stored = [wave(resample(x, 8000, rate).astype("<i2").tobytes(), PCM, rate) for x in speech]
                blocks = [-(-max(len(x), 1) // per) for x in speech]
                coded = encode_ima(speech, block)
                cuts = np.cumsum([0, *blocks])
                files = [wave(coded[cuts[i] * block : cuts[i + 1] * block], IMA_ADPCM, 8000, block) for i in range(len(speech))]
                again = decode_ima(b"".join(read_wave(f)[5] for f in files), block)
                errors = [again[cuts[i] * per : cuts[i] * per + len(x)].astype(np.int64) - x for i, x in enumerate(speech)]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), size(data), sha(data), pa.array([zlib.crc32(d[-UNIT:]) for d in data], pa.int64()), size(media), sha(media),
                    pa.array([feature(decode(m)[1], e) for m, e in zip(stored, errors)]), size(stored), sha(stored), size(files), sha(files),
                ], [x.split()[0] for x in names.split(", ")])

    names = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, adpcm_bytes long, adpcm_sha256 string"
    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}" + names.removeprefix("id long"))
