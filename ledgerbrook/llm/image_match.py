"""Find cropped and edited copies among images by local descriptors.

Each image is decoded (PNG, PGM or PPM), greyed and searched for corners on several scales. A corner's patch is turned by
its intensity centroid and described by 256 binary tests. Every local maximum of a neighbourhood is a corner, so a crop
keeps the corners of what it shows.

Hamming tables hold pairs of corners: a corner with each of its ``NEAR`` nearest beyond its own patch. The key samples
bits of both descriptors and the coarse place and turn of one corner seen from the other; so a structure that many
pictures have in common rarely makes a key that they share. Beside the key stand further bits of both; entries of one key
whose bits differ little are a match, which counts twice if they hardly differ. Up to ``PAIR_ALL`` entries of a key are compared outright; in a longer run all meet
the first one, and the run is kept. Two images whose matches count ``LEAST`` are candidates. For each the matched descriptors of both images (at most ``max_bits`` of 256 bits apart) vote for a similarity transform; a pair with
``min_inliers`` matches that agree is a link. Kept runs whose members fall to several components are compared block by
block: first their keys, which tells the images with enough matches, then these images' descriptors, in place; only links
that join components leave a task. So one group of thousands of copies costs a link for each.

Images of equal pixels are one class from the start, so thousands of exact copies cost no more than one.

Defined results: images that are null or can't be decoded (JPEG among them), and images without a corner, match only
images of equal pixels, or (undecodable) of equal bytes; pictures of more than ``PIXELS`` pixels are averaged down while
they are read; repeated rows are copies; null ids take no part; an empty table gives an empty table. Other columns are
ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerbrook.llm.common import bounded_batches, join_checked, lean, shared
from ledgerbrook.llm.components import components
from ledgerbrook.llm.jaccard_join import meetings

#: Largest side of the working copy, scales, half width of a patch, half width of the neighbourhood that a corner tops.
SIDE, SCALES, PATCH, TOPS = 128, (1.0, 0.71, 0.5), 10, 3
#: Neighbours of a corner in the tables, bits of either descriptor in a key and beside it, how many of these may differ in
#: a match, and in one that counts twice.
NEAR, KEY_BITS, CHECK_BITS, CHECK_OFF, CLOSE_OFF = 3, 20, 64, 7, 5
#: Steps of a circle that a key tells apart, and pixels of a step of distance.
TURNS, FAR = 8, 6
#: Matches of a candidate; entries of a key that are compared outright.
LEAST, PAIR_ALL = 2, 256
#: A larger picture is averaged down while it is read.
PIXELS = 1 << 24
#: A corner: its place in 1/256 of a pixel of the working copy, its turn in 1/256 of a circle, its scale's number.
POINT = np.dtype([("x", "<u2"), ("y", "<u2"), ("turn", "u1"), ("scale", "u1"), ("bits", "u1", 32)])
KEYED, KEYED_TEXT = np.dtype([("key", "<i8"), ("one", "<u8"), ("two", "<u8")]), np.dtype([("key", ">i8"), ("one", ">u8"), ("two", ">u8")])
ENTRY = np.dtype([*((n, KEYED[n]) for n in KEYED.names), ("cls", "<i8")])
#: In a parcel the class is a place in the parcel's list of classes.
PARCELLED = np.dtype([*((n, KEYED[n]) for n in KEYED.names), ("at", "<u2")])
#: Entries that one task sorts.
ENTRIES = 1_600_000


def unfiltered(data: bytes, height: int, octets: int, step: int):
    """A PNG's rows of bytes, one after another, from its filtered rows; ``step`` is the bytes of a pixel."""
    up = bytearray(octets)
    for i in range(height):
        at = i * (octets + 1)
        kind, line = data[at], data[at + 1 : at + 1 + octets]
        if len(line) < octets or kind > 4:
            raise ValueError("PNG is cut short")
        if kind == 0:
            own = bytearray(line)
        elif kind == 1:
            wide = np.zeros(-(-octets // step) * step, np.uint8)
            wide[:octets] = np.frombuffer(line, np.uint8)
            own = bytearray(np.add.accumulate(wide.reshape(-1, step), axis=0, dtype=np.uint8).tobytes()[:octets])
        elif kind == 2:
            own = bytearray((np.frombuffer(line, np.uint8) + np.frombuffer(bytes(up), np.uint8)).tobytes())
        else:
            own = bytearray(line)
            for j in range(min(step, octets)):
                own[j] = (own[j] + (up[j] >> 1 if kind == 3 else up[j])) & 255
            if kind == 3:
                for j in range(step, octets):
                    own[j] = (own[j] + ((own[j - step] + up[j]) >> 1)) & 255
            else:
                for j in range(step, octets):
                    a, b, c = own[j - step], up[j], up[j - step]
                    x, y = b - c, a - c
                    z = abs(x + y)
                    x, y = abs(x), abs(y)
                    own[j] = (own[j] + (a if x <= y and x <= z else b if y <= z else c)) & 255
        yield bytes(own)
        up = own


#: Adam7: first column and row, and steps, of each pass; fixed values of the format.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_rows(data: bytes):
    """(height, width) of a PNG and its rows of grey values."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, color, _, _, lace = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3).mean(axis=1)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("unsupported PNG")
    raw = zlib.decompress(b"".join(body))

    def rows(data, height, width):
        octets = (width * planes * depth + 7) // 8
        for line in unfiltered(data, height, octets, max(1, planes * depth // 8)):
            v = np.frombuffer(line, np.uint8)
            if depth == 16:
                v = v[::2]
            elif depth < 8:
                v = np.unpackbits(v).reshape(-1, depth)[: width * planes] @ (1 << np.arange(depth)[::-1])
            v = v.reshape(width, planes)
            if color == 3:
                yield palette[v[:, 0]].astype(np.float32)
                continue
            grey = v[:, :3].mean(axis=1) if planes >= 3 else v[:, 0]
            yield (grey * (255 / ((1 << depth) - 1)) if depth < 8 else grey).astype(np.float32)

    if not lace:
        return height, width, rows(raw, height, width)
    out, at = np.zeros((height, width), np.float32), 0
    for x, y, dx, dy in PASSES:
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            for i, line in enumerate(rows(raw[at:], h, w)):
                out[y + i * dy, x::dx] = line
            at += h * (1 + (w * planes * depth + 7) // 8)
    return height, width, iter(out)


def pnm_rows(data: bytes):
    """The same of a binary PGM or PPM of 8 bits."""
    kind, width, height, _ = data.split(None, 4)[:4]
    planes, width, height = (3 if kind == b"P6" else 1), int(width), int(height)
    pixels = np.frombuffer(data[-width * height * planes :], np.uint8).reshape(height, width, planes)
    return height, width, (row.mean(axis=1).astype(np.float32) for row in pixels)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Grey values of an image, of a large one averaged down, and one number for equal pixels."""
    height, width, rows = (pnm_rows if data[:2] in (b"P5", b"P6") else png_rows)(data)
    k = math.ceil(math.sqrt(height * width / PIXELS))
    mark, held, out = xxhash.xxh3_64(seed=height), [], []
    for row in rows:
        mark.update(row.tobytes())
        if k == 1:
            out.append(row)
            continue
        held.append(row[: width // k * k].reshape(-1, k).mean(axis=1))
        if len(held) == k:
            out.append(np.mean(held, axis=0))
            held = []
    return np.stack(out), mark.intdigest() - (1 << 63)


def encode_png(grey: np.ndarray) -> bytes:
    """Grey values as an 8-bit PNG."""
    grey = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    raw = np.concatenate([np.zeros((len(grey), 1), np.uint8), grey], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    y = np.clip((np.arange(height) + 0.5) * grey.shape[0] / height - 0.5, 0, grey.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * grey.shape[1] / width - 0.5, 0, grey.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx
    low = grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def blur(a: np.ndarray, n: int = 1) -> np.ndarray:
    for _ in range(n):
        p = np.pad(a, 1, mode="edge")
        a = (p[:-2, 1:-1] + 2 * p[1:-1, 1:-1] + p[2:, 1:-1]) / 4
        p = np.pad(a, 1, mode="edge")
        a = (p[1:-1, :-2] + 2 * p[1:-1, 1:-1] + p[1:-1, 2:]) / 4
    return a


@cache
def tests() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 256 point pairs of the binary tests, and the patch's points for its centroid."""
    rng = np.random.default_rng(1)
    pairs = np.clip(rng.normal(0, PATCH / 2.5, (256, 4)), -PATCH + 2, PATCH - 2).astype(np.float32)
    grid = np.stack(np.meshgrid(np.arange(-PATCH + 2, PATCH - 1), np.arange(-PATCH + 2, PATCH - 1)), axis=-1).reshape(-1, 2)
    return pairs[:, :2], pairs[:, 2:], grid[(grid**2).sum(axis=1) <= (PATCH - 2) ** 2]


def highest(a: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value within ``reach`` rows and columns."""
    p, n = np.pad(a, reach, constant_values=-np.inf), 2 * reach + 1
    rows = np.max([p[i : i + a.shape[0]] for i in range(n)], axis=0)
    return np.max([rows[:, j : j + a.shape[1]] for j in range(n)], axis=0)


def describe(grey: np.ndarray) -> np.ndarray:
    """Corners of an image's working copy with their descriptors."""
    fit = min(1.0, SIDE / max(grey.shape))
    if fit < 1:
        grey = resize(blur(grey, 2), max(1, int(grey.shape[0] * fit)), max(1, int(grey.shape[1] * fit)))
    one, two, disc = tests()
    found = []
    for level, scale in enumerate(SCALES):
        height, width = int(grey.shape[0] * scale), int(grey.shape[1] * scale)
        if min(height, width) < 2 * PATCH + 3:
            break
        a = blur(grey if scale == 1 else resize(blur(grey), height, width), 2)
        dy, dx = np.gradient(a)
        xx, yy, xy = blur(dx * dx, 2), blur(dy * dy, 2), blur(dx * dy, 2)
        strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = np.full_like(strength, -np.inf)
        inner[PATCH:-PATCH, PATCH:-PATCH] = strength[PATCH:-PATCH, PATCH:-PATCH]
        y, x = np.nonzero((inner == highest(inner, TOPS)) & (inner > 1.0))
        if not len(x):
            continue
        patch = a[y[:, None] + disc[:, 1], x[:, None] + disc[:, 0]]
        turn = np.arctan2((patch * disc[:, 1]).sum(axis=1), (patch * disc[:, 0]).sum(axis=1))
        c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]

        def at(points, c=c, s=s, x=x, y=y, a=a):
            px = np.rint(x[:, None] + c * points[:, 0] - s * points[:, 1]).astype(int)
            py = np.rint(y[:, None] + s * points[:, 0] + c * points[:, 1]).astype(int)
            return a[np.clip(py, 0, a.shape[0] - 1), np.clip(px, 0, a.shape[1] - 1)]

        out = np.zeros(len(x), POINT)
        out["x"], out["y"], out["turn"], out["scale"] = np.rint(x / scale * 256), np.rint(y / scale * 256), np.rint(turn / (2 * np.pi) * 256).astype(int) & 255, level
        out["bits"] = np.packbits(at(one) < at(two), axis=1)
        found.append(out)
    return np.concatenate(found) if found else np.zeros(0, POINT)


@cache
def samples() -> tuple[np.ndarray, np.ndarray]:
    """Orders of the 256 bits for a pair's first and second corner: those of the key, then those beside it."""
    rng = np.random.default_rng(2)
    return rng.permutation(256), rng.permutation(256)


def number(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1], dtype=np.int64))


def keys_of(points: np.ndarray) -> np.ndarray:
    """Keys and further bits of an image's corner pairs, one for each key."""
    bits, out = np.unpackbits(points["bits"], axis=1), [np.zeros(0, KEYED)]
    one, two = samples()
    upto = KEY_BITS + CHECK_BITS
    parts = [number(bits[:, order[a:b]]) for order in (one, two) for a, b in ((0, KEY_BITS), (KEY_BITS, upto))]
    for level, scale in enumerate(SCALES):
        own = np.flatnonzero(points["scale"] == level)
        if len(own) < 2:
            continue
        z = (points["x"][own] / 256 + 1j * (points["y"][own] / 256)) * scale
        seen = z[None] - z[:, None]
        far = np.abs(seen)
        far[far < PATCH] = np.inf  # patches that overlap tell the same twice
        near = np.argsort(far, axis=1, kind="stable")[:, :NEAR]
        i, slot = np.nonzero(np.isfinite(np.take_along_axis(far, near, 1)))
        j = near[i, slot]
        turn = points["turn"][own] / 256
        place = np.floor((np.angle(seen[i, j]) / (2 * np.pi) - turn[i]) % 1 * TURNS).astype(np.int64) % TURNS
        turned = np.floor((turn[j] - turn[i]) % 1 * TURNS).astype(np.int64) % TURNS
        step = np.minimum((far[i, j] - PATCH) // FAR, 3).astype(np.int64)
        made = np.zeros(len(i), KEYED)
        made["key"] = ((((parts[0][own[i]] << KEY_BITS | parts[2][own[j]]) * TURNS + place) * TURNS) + turned) * 4 + step
        made["one"], made["two"] = parts[1][own[i]].view(np.uint64), parts[3][own[j]].view(np.uint64)
        out.append(made)
    all_of = np.concatenate(out)
    return all_of[np.unique(all_of["key"], return_index=True)[1]]


def weight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two entries of a key count: 2 if the bits beside it are nearly the same for both corners, 1 if they are alike, else 0."""
    off = np.maximum(np.bitwise_count(a["one"] ^ b["one"]), np.bitwise_count(a["two"] ^ b["two"]))
    return (off <= CHECK_OFF).astype(np.uint8) + (off <= CLOSE_OFF)


def parcel(entries: np.ndarray) -> bytes:
    """Entries of at most 65,536 classes as bytes."""
    classes, at = np.unique(entries["cls"], return_inverse=True)
    out = np.empty(len(entries), PARCELLED)
    for n in KEYED.names:
        out[n] = entries[n]
    out["at"] = at
    return np.int64(len(classes)).tobytes() + classes.tobytes() + out.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    held = np.frombuffer(blob, PARCELLED, offset=8 + 8 * n)
    out = np.empty(len(held), ENTRY)
    for name in KEYED.names:
        out[name] = held[name]
    out["cls"] = np.frombuffer(blob, np.int64, n, offset=8)[held["at"]]
    return out


def consensus(a: np.ndarray, b: np.ndarray) -> int:
    """The most matched points (a[i] with b[i]) that one similarity transform explains, each place counted once."""
    if len(a) < 3:
        return 0
    best = 0
    za, zb = (p["x"] / 256 + 1j * (p["y"] / 256) for p in (a, b))
    grain = 1 / np.array(SCALES)
    turns = np.exp(2j * np.pi / 256 * (b["turn"].astype(float) - a["turn"].astype(float))) * (grain[b["scale"]] / grain[a["scale"]])
    for i in range(len(a)):
        ratio = turns[i]
        if not 0.4 < abs(ratio) < 2.5:
            continue
        far = np.abs(za - za[i])
        near = (np.abs((zb - zb[i]) - ratio * (za - za[i])) <= 2.5 + 0.06 * far) & (np.abs(turns - ratio) <= 0.45 * abs(ratio))
        at = lambda z: len({(round(float(p.real) / 3), round(float(p.imag) / 3)) for p in z[near]})  # noqa: B023, E731
        best = max(best, min(at(za), at(zb)))
    return best


def agreeing(a: np.ndarray, b: np.ndarray, max_bits: int) -> int:
    """``consensus`` of two images' corners whose descriptors differ in at most ``max_bits`` bits."""
    x, y = (np.ascontiguousarray(p["bits"]).view(np.uint64) for p in (a, b))
    far = sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.uint16) for k in range(4))
    i, j = np.nonzero(far <= max_bits)
    return consensus(a[i], b[j])


def matches_of(e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches (a, b, weight) with a < b among entries of whole keys, and which entries, sorted and each once, are in kept runs."""
    e = e[np.lexsort((e["cls"], e["key"]))]
    new = np.ones(len(e), dtype=bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["cls"][1:] != e["cls"][:-1])
    e = e[new]  # copies of a class came from several tasks
    start = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]])) if len(e) else np.zeros(0, np.int64)
    length = np.diff([*start, len(e)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(length[(length > 1) & (length <= PAIR_ALL)]):
        at = start[length == size]
        i, j = np.triu_indices(size, 1)
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    for a, n in zip(start[length > PAIR_ALL], length[length > PAIR_ALL], strict=True):
        left.append(np.full(n - 1, a))
        right.append(np.arange(a + 1, a + n))
    i, j = np.concatenate(left), np.concatenate(right)
    counts = weight(e[i], e[j])
    ok = counts > 0
    return e["cls"][i[ok]], e["cls"][j[ok]], counts[ok], e[np.repeat(length > PAIR_ALL, length)]


def _both(rows: pa.Table, kind: np.dtype):
    """The two sides of a meeting: classes, roots and blobs; a block that meets itself stands on both."""
    side, cls, root = (rows[c].to_numpy() for c in ("side", "cls", "root"))
    blobs = [np.frombuffer(x.as_buffer(), kind) for x in rows["data"]]
    for k in (0, 1):
        own = np.flatnonzero((side == k) | (side == 2))
        own = own[np.unique(cls[own], return_index=True)[1]]
        yield cls[own], root[own], [blobs[i] for i in own]


def match_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right): the weights of two images' matches."""
    x, y = np.concatenate(left), np.concatenate(right)
    of_x, of_y = np.repeat(np.arange(len(left)), [len(v) for v in left]), np.repeat(np.arange(len(right)), [len(v) for v in right])
    count = np.zeros((len(left), len(right)), dtype=np.uint16)
    both = np.intersect1d(x["key"], y["key"])
    (x, of_x), (y, of_y) = ((v[order], of[order]) for v, of in ((x, of_x), (y, of_y)) for order in (np.argsort(v["key"], kind="stable"),))
    ends = [np.searchsorted(v["key"], both, side) for v in (x, y) for side in ("left", "right")]
    for a, b, c, d in zip(*ends, strict=True):  # an image holds a key once
        count[np.ix_(of_x[a:b], of_y[c:d])] += weight(x[a:b, None], y[None, c:d])
    return count


def promising(rows: pa.Table) -> np.ndarray:
    """The classes of a meeting with enough matches in the family's kept runs with one of another component."""
    (a, root_a, left), (b, root_b, right) = _both(rows, KEYED_TEXT)
    left, right = ([v.astype(KEYED) for v in side] for side in (left, right))
    i, j = np.nonzero((match_counts(left, right) >= LEAST) & (root_a[:, None] != root_b[None]))
    return np.union1d(a[i], b[j])


def joining(rows: pa.Table, max_bits: int, min_inliers: int) -> tuple[list[int], list[int]]:
    """Links of a meeting's candidates, those with most matches first, no more than it takes to join components."""
    (a, root_a, left), (b, root_b, right) = _both(rows, POINT)
    count = match_counts([keys_of(p) for p in left], [keys_of(p) for p in right])
    i, j = np.nonzero((count >= LEAST) & (root_a[:, None] != root_b[None]))
    above, u, v = {int(r): int(r) for r in np.union1d(root_a, root_b)}, [], []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for k in np.argsort(-count[i, j].astype(np.int64), kind="stable"):
        p, q = top(int(root_a[i[k]])), top(int(root_b[j[k]]))
        if p != q and agreeing(left[i[k]], right[j[k]], max_bits) >= min_inliers:
            above[p] = q
            u.append(int(a[i[k]]))
            v.append(int(b[j[k]]))
    return u, v


def similar_images(images: DataFrame, id_col: str = "id", data_col: str = "data", max_bits: int = 24, min_inliers: int = 5) -> DataFrame:
    """Per image: its id, class_id (smallest id of equal pixels), n_points (corners) and group_id (smallest id reachable)."""
    bounded_batches(images.sparkSession)
    source = images.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{data_col}`").alias("data"))

    def extract(batches):
        """A class's corners stand with the first of its images only, as far as a task remembers."""
        seen: dict[int, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                cls, n, points = [], [], []
                for data in part.column(1).to_pylist():
                    own, count, blob = None, 0, None
                    if data is not None:
                        try:
                            grey, own = decode(data)
                            if own in seen:
                                count = seen[own]
                            else:
                                found = describe(grey)
                                count, blob = len(found), found.tobytes() or None
                                if len(seen) > 100_000:
                                    seen.clear()
                                seen[own] = count
                        except (ValueError, KeyError, IndexError, TypeError, zlib.error, struct.error, UnboundLocalError):
                            own = xxhash.xxh3_64_intdigest(data, seed=1 << 40) - (1 << 63)
                    cls.append(own)
                    n.append(count)
                    points.append(blob)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(points, pa.binary())], names=["id", "cls", "n_points", "points"])

    all_of = shared(source.mapInArrow(lean(extract), "id long, cls long, n_points int, points binary"))
    one = all_of.where("points is not null").select("cls", "points")
    corners = one.agg(F.coalesce(F.sum(F.octet_length("points")), F.lit(0))).first()[0] // POINT.itemsize
    buckets = max(1, corners * NEAR // ENTRIES)

    def parcels(batches):
        """Entries in parcels, one for each bucket of keys."""
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, made = batch.slice(lo, 1000), []
                for c, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if c in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(c)
                    keyed = keys_of(np.frombuffer(data.as_buffer(), POINT))
                    own = np.zeros(len(keyed), ENTRY)
                    own["key"], own["one"], own["two"], own["cls"] = keyed["key"], keyed["one"], keyed["two"], c
                    made.append(own)
                if not made:
                    continue
                every = np.concatenate(made)
                bucket = (every["key"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                every, bucket = every[order], bucket[order]
                ids, at = np.unique(bucket, return_index=True)
                blobs = [parcel(every[a:b]) for a, b in zip(at, [*at[1:], len(every)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def match(_, rows):
        a, b, counts, runs = matches_of(np.concatenate([unpacked(x) for x in rows["entries"].to_pylist()]))
        both, of = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True)
        count = np.bincount(of.ravel(), weights=counts, minlength=len(both))
        kind = np.repeat([0, 1], [len(both), len(runs)]).astype(np.int32)
        cols = [kind, np.concatenate([both[:, 0], runs["key"]]), np.concatenate([both[:, 1], runs["cls"]]), np.concatenate([count.astype(np.int64), runs["one"].view(np.int64)]), np.concatenate([np.zeros(len(both), np.int64), runs["two"].view(np.int64)])]
        return pa.table([pa.array(c) for c in cols], names=["kind", "a", "b", "n", "m"])

    found = shared(one.mapInArrow(lean(parcels), "bucket long, entries binary").groupBy("bucket").applyInArrow(match, "kind int, a long, b long, n long, m long"))
    pairs = shared(found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("a", "b"))
    runs = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls"), F.col("n").alias("one"), F.col("m").alias("two"))

    def points_of(needed: DataFrame) -> DataFrame:
        """The corners of the classes ``needed`` (cls)."""
        ids = shared(needed.select(F.col("cls").alias("needed")).distinct())
        return join_checked(one, ids, F.col("cls") == F.col("needed"), "left_semi", 24).dropDuplicates(["cls"])

    def agree(batches):
        for batch in batches:
            good = [agreeing(*(np.frombuffer(x.as_buffer(), POINT) for x in both), max_bits) >= min_inliers for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    points = points_of(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))))
    pa_, pb = points.select(F.col("cls").alias("a"), F.col("points").alias("at_a")), points.select(F.col("cls").alias("b"), F.col("points").alias("at_b"))
    links = shared(pairs.join(pa_, "a").join(pb, "b").select("a", "b", "at_a", "at_b").mapInArrow(lean(agree), "u long, v long"))
    roots = shared(components(links))
    placed = runs.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    held = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("family"), F.count(F.lit(1)).alias("roots"))
    hexed = F.concat(*(F.lpad(F.hex(c), 16, "0") for c in KEYED.names))
    inside = shared(placed.join(held.where("roots > 1").select("key", "family"), "key").groupBy("family", "cls").agg(F.first("root").alias("root"), F.collect_set(hexed).alias("keys")))
    if not inside.isEmpty():
        as_member = lambda df, data: df.select("family", "cls", F.lit(1).cast("long").alias("n"), "root", F.lit(0).cast("long").alias("more"), data.alias("data"))
        met = meetings(as_member(inside, F.unhex(F.array_join("keys", ""))), 75)

        def look(key, rows):
            cls = promising(rows)
            return pa.table([pa.array(np.full(len(cls), rows["family"][0].as_py()), pa.int64()), pa.array(cls, pa.int64())], names=["family", "cls"])

        def join(key, rows):
            u, v = joining(rows, max_bits, min_inliers)
            return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        chances = shared(met.groupBy("meet").applyInArrow(look, "family long, cls long").distinct())
        whole = inside.select("family", "cls", "root").join(chances, ["family", "cls"]).join(points_of(chances), "cls")
        later = meetings(as_member(whole, F.col("points")), 75).groupBy("meet").applyInArrow(join, "u long, v long")
        roots = shared(components(links.union(shared(later.distinct()))))
    heads = all_of.where("cls is not null").groupBy("cls").agg(F.min("id").alias("class_id"))
    rooted = heads.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    groups = rooted.groupBy("root").agg(F.min("class_id").alias("group_id"))
    classes = rooted.join(groups, "root").select("cls", "class_id", "group_id")
    out = all_of.select("id", "cls", "n_points").join(classes, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), "n_points", F.coalesce("group_id", "id").alias("group_id"))


def paint(vector: np.ndarray, size: int = 96) -> np.ndarray:
    """A picture that a vector determines: soft noise of two grains with shapes on it."""
    seed = int(np.abs(np.asarray(vector, dtype=np.float64) * 1e6).astype(np.int64).sum() % (1 << 31))
    rng = np.random.default_rng([seed, len(vector)])
    out = 128 + 40 * resize(rng.normal(0, 1, (10, 10)), size, size) + 18 * resize(rng.normal(0, 1, (28, 28)), size, size)
    for _ in range(22):
        x, y, w, h = rng.integers(0, size - 8), rng.integers(0, size - 8), rng.integers(5, 26), rng.integers(5, 26)
        out[y : y + h, x : x + w] += rng.normal(0, 55)
    return np.clip(out, 0, 255)


def edit(picture: np.ndarray, way: int) -> np.ndarray:
    """Way 1 crops, way 2 changes brightness and contrast and adds noise; others change nothing."""
    if way == 1:
        return picture[8:-10, 12:-6]
    if way == 2:
        noise = np.random.default_rng(9).normal(0, 3, picture.shape)
        return np.clip(picture * 0.85 + 14 + noise, 0, 255)
    return picture


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 8) -> DataFrame:
    """A media column for tables that have none: (id, data), a PNG for each vector.

    Of each run of ``every`` ids, the second is a cropped and the third an edited copy of the first.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    way = F.pmod("id", F.lit(every))
    copies = rows.where(way.isin(0)).select(F.explode(F.array([F.lit(k) for k in (0, 1, 2)])).alias("k"), "id", "v").select((F.col("id") + F.col("k")).alias("id"), F.col("v").alias("base"))
    rows = rows.join(copies, "id", "left").select("id", F.coalesce("base", "v").alias("v"), F.when(F.col("base").isNotNull(), way).otherwise(0).cast("int").alias("way"))

    def run(batches):
        for batch in batches:
            data = [None if v is None or None in v else encode_png(edit(paint(np.array(v)), w)) for v, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return rows.mapInArrow(run, T._parse_datatype_string("id long, data binary"))
