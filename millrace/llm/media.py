"""Media columns: GIF files written and decoded, with timed frames and colour histograms.

`decode` handles any GIF: local and global palettes, sub-blocks, interlacing, transparency and the
four disposal methods, composited on a canvas. Code streams that start with a clear code, hold no
other and stay under 11 bits are decoded many at a time: code widths then depend on the position
alone, so codes are unpacked as bit matrices; string lengths follow code by code over all frames at
once, and samples by pointer doubling, since a table entry is a stretch of the frame's own output.
Other streams are decoded one by one. Encoding runs the dictionary search in step over many frames.

A payload is UTF-8 text padded with bytes 255 to frames of 24 x 24 samples; the red level of what a
frame shows is the payload. Frames are stored as an animation is: samples equal to what the canvas
shows already are transparent (byte 192 marks them, which no UTF-8 text holds), the canvas is kept,
given back or cleared after a frame by a fixed rule of its number, and every eighth frame has a local
palette in another order. The payload is read back from the composited pictures.

Null text is the empty text (one frame of 255). Equal texts give equal bytes. Repeated rows and
null ids are handled row by row; an empty table gives no rows. A null `gif` gives nulls; a file that
is no GIF, is cut off, or would show 2 GB or more gives nulls and the reason in `error`.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, by_bytes, table

SIDE = 24
FRAME = SIDE * SIDE
TAIL = 32  # bytes of a payload that tail_crc32 covers
DELAY_CS = 10
BLOCK = 1024  # frames coded in step
SLOTS = 2048  # of a frame's dictionary; a frame adds under 576 entries
STEP = 255  # codes of 9 bits after a clear code
BINS = 16
CLEAR, END = 256, 257
UNSEEN = 192  # a byte that is in no UTF-8 text
KEEP, BACK, RESTORE = 1, 2, 3  # disposal: leave the frame, clear it, go back to what was before


# ---- LZW, many frames in step


def lzw_encode(x: np.ndarray) -> list[bytes]:
    """Greedy LZW code streams (8-bit samples) of the rows of x, of at most 700 samples each."""
    frames, n = x.shape
    base = np.arange(frames) * SLOTS
    keys, codes = np.full(frames * SLOTS, -1, np.int32), np.zeros(frames * SLOTS, np.int32)
    out, count = np.full((frames, n + 1), 0, np.int32), np.zeros(frames, np.int64)
    columns = np.ascontiguousarray(x.T).astype(np.int32)
    cur = columns[0]
    for nxt in columns[1:]:
        key = (cur << 8) | nxt
        slot = base + ((key.astype(np.int64) * 40503 >> 5) & (SLOTS - 1))
        got = keys[slot]
        lost = np.flatnonzero((got != key) & (got != -1))
        while lost.size:
            s = slot[lost]
            s = (s & ~(SLOTS - 1)) | ((s + 1) & (SLOTS - 1))
            slot[lost] = s
            g = keys[s]
            got[lost] = g
            lost = lost[(g != key[lost]) & (g != -1)]
        hit = got == key
        miss = np.flatnonzero(~hit)
        at = slot[miss]
        out[miss, count[miss]] = cur[miss]
        keys[at], codes[at] = key[miss], 258 + count[miss]
        count[miss] += 1
        cur = np.where(hit, codes[slot], nxt)
    rows = np.arange(frames)
    out[rows, count] = cur
    count += 1
    full = np.zeros((frames, n + 2), np.int32)
    full[:, : n + 1] = out
    full[rows, count] = END
    full[np.arange(n + 2) > count[:, None]] = 0
    first = np.broadcast_to(np.array([CLEAR >> b & 1 for b in range(9)], np.uint8), (frames, 9))
    narrow = ((full[:, :STEP, None] >> np.arange(9)) & 1).astype(np.uint8).reshape(frames, -1)
    wide = ((full[:, STEP:, None] >> np.arange(10)) & 1).astype(np.uint8).reshape(frames, -1)
    packed = np.packbits(np.concatenate([first, narrow, wide], axis=1), axis=1, bitorder="little")
    codes_out = count + 1
    sizes = (9 + 9 * np.minimum(codes_out, STEP) + 10 * np.maximum(codes_out - STEP, 0) + 7) // 8
    return [packed[f, : sizes[f]].tobytes() for f in range(frames)]


def lzw_decode_many(streams: list[bytes], n: int) -> np.ndarray | None:
    """Rows of n samples; None if a stream isn't of the kind that decodes in step."""
    frames = len(streams)
    sizes = np.array([len(s) for s in streams])
    raw = np.zeros((frames, int(sizes.max()) + 2), np.uint8)
    raw[np.arange(raw.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(streams), np.uint8)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    head, rest = bits[:, :9], bits[:, 9:]
    if not (head @ (1 << np.arange(9)) == CLEAR).all():
        return None
    a = min(STEP, rest.shape[1] // 9)
    b = max(0, (rest.shape[1] - 9 * STEP) // 10)
    codes = rest[:, : 9 * a].reshape(frames, a, 9).astype(np.int32) @ (1 << np.arange(9))
    if b:
        codes = np.concatenate([codes, rest[:, 9 * STEP : 9 * STEP + 10 * b].reshape(frames, b, 10).astype(np.int32) @ (1 << np.arange(10))], axis=1)
    ends = codes == END
    count = ends.argmax(axis=1)
    width = int(count.max())
    if not ends.any(axis=1).all() or width > 766 or not width:
        return None
    codes = codes[:, :width]
    live = np.arange(width) < count[:, None]
    entry = codes - 258
    if ((codes == CLEAR) & live).any() or ((entry >= np.arange(width)) & live).any():
        return None
    literal = codes < 256
    lengths, rows = np.zeros((width, frames), np.int32), np.arange(frames)
    for j in range(width):
        ref = np.maximum(entry[:, j], 0)
        lengths[j] = np.where(literal[:, j], 1, lengths[ref, rows] + 1) * live[:, j]
    lengths = lengths.T
    if not (lengths.sum(axis=1) == n).all():
        return None
    starts = np.cumsum(lengths, axis=1) - lengths + (rows * n)[:, None]
    flat = lengths.ravel()
    source = np.where(literal, starts, np.take_along_axis(starts, np.maximum(entry, 0), 1)).ravel()
    pointer = np.repeat(source - starts.ravel(), flat) + np.arange(frames * n)
    value = np.repeat(np.where(literal, codes, 0).ravel().astype(np.uint8), flat)
    while not np.array_equal(after := pointer[pointer], pointer):
        pointer = after
    return value[pointer].reshape(frames, n)


def lzw_decode(data: bytes, min_size: int, n: int) -> bytes:
    """Any LZW code stream of a GIF image, up to n samples."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    start = [bytes([i]) for i in range(clear)] + [b"", b""]
    strings, size, last, out, held, bits, done = list(start), min_size + 1, None, bytearray(), 0, 0, False
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= size and not done:
            code = held & ((1 << size) - 1)
            held >>= size
            bits -= size
            if code == clear:
                strings, size, last = list(start), min_size + 1, None
                continue
            if code == end:
                done = True
                break
            if last is None:
                s = strings[code]
            else:
                if code > len(strings):
                    raise ValueError("LZW code beyond the table")
                s = strings[code] if code < len(strings) else last + last[:1]
                if len(strings) < 4096:
                    strings.append(last + s[:1])
                    if len(strings) == 1 << size and size < 12:
                        size += 1
            out += s
            last = s
        if done or len(out) >= n:
            break
    return bytes(out[:n])


# ---- the container


@functools.cache
def colours(shift: int = 0) -> bytes:
    """A palette whose index i has the red level i + shift, modulo 256; green and blue follow from red."""
    return bytes(x for i in range(256) for v in [(i + shift) % 256] for x in (v, (7 * v + 85) % 256, 255 - v))


def _rule(j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the frames numbered j in their files: disposal, palette's shift, and how many frames back the canvas shows (0: none)."""
    disposal = np.where(j % 8 == 3, RESTORE, np.where(j % 8 == 6, BACK, KEEP))
    back = np.where((j == 0) | (j % 8 == 7), 0, np.where(j % 8 == 4, 2, 1))
    return disposal, np.where(j % 8 == 1, 128, 0), back


def store_frames(x: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Colour indices of payload frames x, the j-th of their files, which follow each other."""
    _, shift, back = _rule(j)
    same = (x == x[np.arange(len(x)) - back]) & (back > 0)[:, None]
    return ((np.where(same, UNSEEN, x).astype(np.int64) - shift[:, None]) % 256).astype(np.uint8)


def gif_file(streams: list[bytes], side: int = SIDE, delay: int = DELAY_CS) -> bytes:
    """A GIF of one full frame for each code stream, with the disposal, palettes and transparency of the rule."""
    parts = [b"GIF89a", struct.pack("<HHBBB", side, side, 0xF7, 0, 0), colours()]
    rules = zip(*(r.tolist() for r in _rule(np.arange(len(streams)))), strict=True)
    box = b"\x2c" + struct.pack("<HHHH", 0, 0, side, side)
    for s, (disposal, shift, back) in zip(streams, rules, strict=True):
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (back > 0), delay, (UNSEEN - shift) % 256, 0) + box)
        parts.append(b"\x87" + colours(shift) + b"\x08" if shift else b"\0\x08")
        for lo in range(0, len(s), 255):
            piece = s[lo : lo + 255]
            parts.append(bytes([len(piece)]))
            parts.append(piece)
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


def _blocks(gif: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := gif[at]:
        parts.append(gif[at + 1 : at + 1 + size])
        at += size + 1
    return b"".join(parts), at + 1


def parse(gif: bytes) -> dict:
    """Screen size, background and the images: place, palette, code stream, delay, disposal, transparency."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", gif, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = gif[at : at + size], at + size
    images, control = [], (0, 0, None)
    while gif[at] != 0x3B:
        kind = gif[at]
        if kind == 0x21:
            label = gif[at + 1]
            data, at = _blocks(gif, at + 2)
            if label == 0xF9:
                control = (data[0] >> 2 & 7, data[1] | data[2] << 8, data[3] if data[0] & 1 else None)
        elif kind == 0x2C:
            x, y, w, h, f = struct.unpack_from("<HHHHB", gif, at + 1)
            at, palette = at + 10, shared
            if f & 0x80:
                size = 3 << ((f & 7) + 1)
                palette, at = gif[at : at + size], at + size
            min_size = gif[at]
            stream, at = _blocks(gif, at + 1)
            images.append({"box": (x, y, w, h), "interlaced": bool(f & 0x40), "palette": palette, "min_size": min_size, "stream": stream, "disposal": control[0], "delay": control[1], "transparent": control[2]})
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown GIF block {kind:#x}")
    return {"size": (width, height), "background": background, "palette": shared, "images": images}


def _samples(gifs: list[dict]) -> None:
    """Adds `samples`, the colour indices, to each image; a file with a broken code stream gets an `error`."""
    alike = [i for g in gifs for i in g["images"] if i["min_size"] == 8 and i["box"][2:] == (SIDE, SIDE)]
    for lo in range(0, len(alike), BLOCK):
        part = alike[lo : lo + BLOCK]
        got = lzw_decode_many([i["stream"] for i in part], FRAME)
        if got is not None:
            for i, s in zip(part, got, strict=True):
                i["samples"] = s
    for g in gifs:
        try:
            for i in g["images"]:
                if "samples" not in i:
                    w, h = i["box"][2:]
                    i["samples"] = np.frombuffer(lzw_decode(i["stream"], i["min_size"], w * h).ljust(w * h, b"\0"), np.uint8)
                if i["interlaced"]:
                    w, h = i["box"][2:]
                    rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                    straight = np.empty((h, w), np.uint8)
                    straight[rows] = i["samples"].reshape(h, w)
                    i["samples"] = straight.ravel()
        except (IndexError, ValueError) as broken:
            g["error"] = f"broken code stream: {broken}"


def composite(gif: dict) -> np.ndarray:
    """RGB frames (n, height, width, 3) as shown, one for each image."""
    (width, height), shown = gif["size"], []
    canvas = np.zeros((height, width, 3), np.uint8)
    for i in gif["images"]:
        (x, y, w, h), before = i["box"], canvas
        palette = np.frombuffer((i["palette"] or b"").ljust(768, b"\0"), np.uint8).reshape(-1, 3)
        index = i["samples"].reshape(h, w)[: max(0, height - y), : max(0, width - x)]
        canvas = canvas.copy()
        box = canvas[y : y + h, x : x + w]
        seen = np.ones(index.shape, bool) if i["transparent"] is None else index != i["transparent"]
        box[seen] = palette[index][seen]
        shown.append(canvas)
        if i["disposal"] == 2:
            canvas = canvas.copy()
            canvas[y : y + h, x : x + w] = 0
        elif i["disposal"] == 3:
            canvas = before
    return np.array(shown, np.uint8).reshape(-1, height, width, 3)


def composite_many(gifs: list[dict]) -> list[np.ndarray]:
    """The same for files of one size whose images all cover the canvas: the n-th frames of all at once."""
    width, height = gifs[0]["size"]
    n = width * height
    order = sorted(range(len(gifs)), key=lambda f: -len(gifs[f]["images"]))
    counts = np.array([len(gifs[f]["images"]) for f in order])
    out = [np.empty((len(g["images"]), n, 3), np.uint8) for g in gifs]
    names: dict[bytes, int] = {}
    for g in gifs:
        for i in g["images"]:
            i["palette_no"] = names.setdefault(i["palette"] or b"", len(names))
    flat = np.concatenate([np.frombuffer(p.ljust(768, b"\0"), np.uint8).reshape(-1, 3) for p in names]) if names else np.zeros((0, 3), np.uint8)
    canvas = np.zeros((len(gifs), n, 3), np.uint8)
    for j in range(int(counts.max(initial=0))):
        k = int((counts > j).sum())
        images = [gifs[f]["images"][j] for f in order[:k]]
        index = np.stack([i["samples"] for i in images]).astype(np.int32)
        clear = np.array([-1 if i["transparent"] is None else i["transparent"] for i in images])
        disposal = np.array([i["disposal"] for i in images])
        shown = flat[index + 256 * np.array([i["palette_no"] for i in images], np.int32)[:, None]]
        hidden = index == clear[:, None]
        shown[hidden] = canvas[:k][hidden]
        for f, picture in zip(order, shown, strict=False):
            out[f][j] = picture
        stays = disposal != RESTORE
        canvas[:k][stays] = shown[stays]
        canvas[:k][disposal == BACK] = 0
    return [x.reshape(-1, height, width, 3) for x in out]


def decode(files: list[bytes | None]) -> list[dict]:
    """Per file the frames' delays in milliseconds and their RGB pictures, or an `error` (null for no file)."""
    gifs = []
    for f in files:
        try:
            g = {"size": (0, 0), "images": [], "error": None} if f is None else parse(f) | {"error": ""}
            if 3 * g["size"][0] * g["size"][1] * len(g["images"]) >= 1 << 31:
                raise ValueError("2 GB of pictures or more")
            gifs.append(g)
        except (IndexError, ValueError, struct.error) as broken:
            gifs.append({"images": [], "error": f"no whole GIF: {broken}"})
    _samples(gifs)
    alike: dict[tuple, list[int]] = {}
    for n, g in enumerate(gifs):
        if g["error"] == "":
            g["delays"] = [10 * i["delay"] for i in g["images"]]
            if all(i["box"] == (0, 0, *g["size"]) for i in g["images"]) and all(g["size"]):
                alike.setdefault(g["size"], []).append(n)
            else:
                g["frames"] = composite(g)
    for group in alike.values():
        for n, frames in zip(group, composite_many([gifs[n] for n in group]), strict=True):
            gifs[n]["frames"] = frames
    return gifs


# ---- columns


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "text", 4_000_000, 1 << 20):
        raw = [(x or "").encode("utf-8", "replace") for x in part.column("text").to_pylist()]
        counts = [max(1, -(-len(r) // FRAME)) for r in raw]
        joined = np.frombuffer(b"".join(r.ljust(n * FRAME, b"\xff") for r, n in zip(raw, counts, strict=True)), np.uint8).reshape(-1, FRAME)
        joined = store_frames(joined, np.concatenate([np.arange(n) for n in counts]))
        streams = [s for lo in range(0, len(joined), BLOCK) for s in lzw_encode(joined[lo : lo + BLOCK])]
        at, files = 0, []
        for n in counts:
            files.append(gif_file(streams[at : at + n]))
            at += n
        yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(r) for r in raw], pa.int64()), "gif": pa.array(files, pa.binary())})


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for part in by_bytes(batches, "gif", 2_000_000, 1 << 20):
        out: dict = {k: [] for k in ("n_frames", "delays_ms", "rgb", "histogram", "error")}
        for g in decode(part.column("gif").to_pylist()):
            frames = g.get("frames")
            out["n_frames"].append(None if frames is None else len(frames))
            out["delays_ms"].append(None if frames is None else g["delays"])
            out["rgb"].append(None if frames is None else frames.tobytes())
            out["histogram"].append(None if frames is None else np.concatenate([np.bincount(frames[..., c].ravel() >> 4, minlength=BINS) for c in range(3)]).tolist())
            out["error"].append(g["error"] or None)
        kinds = {"n_frames": pa.int64(), "delays_ms": longs, "rgb": pa.binary(), "histogram": longs, "error": pa.string()}
        yield pa.record_batch({**{c: part.column(c) for c in part.schema.names}, **{k: pa.array(v, kinds[k]) for k, v in out.items()}})


def store_gifs(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and `gif`, the file that holds the text."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode_batches, "doc_id long, n_bytes long, gif binary")


def gif_columns(files: DataFrame) -> DataFrame:
    """Adds to a `gif` column: frames' number and delays, the RGB samples of all frames as shown, a
    histogram of 16 levels for each colour channel, and the reason where a file can't be read."""
    bound_batches(files.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(_decode_batches, f"{schema}, n_frames long, delays_ms array<long>, rgb binary, histogram array<long>, error string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of gif_columns' rows what op4 returns; the payload is the red channel."""
    for batch in _decode_batches(batches):
        rows = []
        for gif, rgb, n, delays, levels in zip(*(batch.column(c).to_pylist() for c in ("gif", "rgb", "n_frames", "delays_ms", "histogram")), strict=True):
            red = np.frombuffer(rgb, np.uint8)[::3].tobytes()
            rows.append((len(red), hashlib.sha256(red).hexdigest(), zlib.crc32(red[-TAIL:]), len(gif), hashlib.sha256(gif).hexdigest(), ";".join([str(n), str(sum(delays)), ",".join(map(str, levels[:BINS]))]), n))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames")
        kinds = [pa.string() if "sha" in n or n == "feature" else pa.int64() for n in names]
        yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "n_bytes")}, **{n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)}})


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_gifs(table(spark, sf_dir, "documents")).mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long")
