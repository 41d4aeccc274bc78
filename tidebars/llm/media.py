"""Copies of images by local descriptors: cropped, brightened, turned or resized images of one picture.

* Corners (Harris) are found at three scales, half an octave apart, so many for each tile of the picture. Each has the
  direction of its surroundings' centroid, 128 binary tests of a pattern turned into that direction, and three looks that
  brightness and contrast leave alone in ratio: mean, gradient and spread. Tests are chosen once, on generated pictures, to be
  undecided by themselves and little correlated.
* Hamming tables: a corner is entered by what it sees of two of its five nearest corners (direction, turn, distance, ratio of
  looks, all of it relative to itself) together with one of its 16 parts of tests; the sight decides which, so that a wrong
  test spoils few entries. Images meet where they share an entry, and are candidates if they share ``entries`` of them.
* Consensus: corners of two candidates match if their tests differ in at most ``distance`` bits; each match proposes a scale,
  a turn and a shift, and the images are copies if ``least`` distinct corners of each agree on one, refined by least squares.

Chains of copies make classes. Equal bytes are collapsed first. Up to ``FEW`` images of an entry meet each other; a larger
entry first joins all to its least image, and only if more than one class is left in it afterwards, its images are compared
across classes, dealt as pairs of blocks: what is compared there is not written out. So no link is lost, and a picture of
which a third of the table are copies costs a star.

Images are binary PGM (P5, 8 bits).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm._shared import connected_components, materialize, partitions, release, slices

RADIUS, TURNS, LEVELS, TESTS = 9, 64, 3, 128
#: Pixels of a tile's side, and how many corners it may hold at each scale: crops keep their share.
TILE, PER_TILE = 32, 12
#: Nearest corners that a corner looks at, and how far they are at least.
NEAR, APART = 5, 10
#: Images of an entry that all meet each other; those of one map batch that are sent one by one; images of a block.
FEW, LOCAL, BLOCK = 256, 16, 2048
#: Images whose entries a task sends at once, and entries of a bucket.
BATCH, BUCKET = 1024, 2 << 20
#: Larger images are halved until they have no more pixels: bounds a worker's memory.
MOST_PIXELS = 1 << 24
_DISC = np.stack(np.meshgrid(np.arange(-9, 10), np.arange(-9, 10)), -1).reshape(-1, 2)
_DISC = _DISC[(_DISC**2).sum(1) <= 81]
_SPOT = np.dtype([("level", "u1"), ("turn", "u1"), ("x", "<i4"), ("y", "<i4"), ("bits", "<u8", 2)])
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def encode_pgm(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return f"P5\n{w} {h}\n255\n".encode() + pixels.astype(np.uint8).tobytes()


def decode_pgm(raw: bytes | None) -> np.ndarray | None:
    """Pixels, or None for what is not a whole PGM image."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", raw or b"")
    if not m or len(raw) - m.end() < int(m[1]) * int(m[2]):
        return None
    return np.frombuffer(raw, np.uint8, int(m[1]) * int(m[2]), m.end()).reshape(int(m[2]), int(m[1]))


def _box(x: np.ndarray, r: int) -> np.ndarray:
    c = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r)), mode="edge"), 0), 1)
    n = 2 * r + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)


def resize(pixels: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear interpolation."""
    y, x = (np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1) for m, n in ((h, pixels.shape[0]), (w, pixels.shape[1])))
    top, left = (np.clip(v.astype(int), 0, max(n - 2, 0)) for v, n in ((y, pixels.shape[0]), (x, pixels.shape[1])))
    down, right = np.minimum(top + 1, pixels.shape[0] - 1), np.minimum(left + 1, pixels.shape[1] - 1)
    fy, fx = (y - top)[:, None], (x - left)[None]
    rows = pixels[top] * (1 - fy) + pixels[down] * fy
    return rows[:, left] * (1 - fx) + rows[:, right] * fx


def _highest(x: np.ndarray) -> np.ndarray:
    """The largest of the 5 x 5 values around each."""
    for axis in (0, 1):
        p = np.pad(x, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], constant_values=-np.inf)
        x = np.maximum.reduce([p[k : k + x.shape[0]] if axis == 0 else p[:, k : k + x.shape[1]] for k in range(5)])
    return x


def corners(pixels: np.ndarray) -> Iterator[tuple]:
    """For each scale (level, factor, smoothed pixels, x, y, turn, looks) of its corners, x and y in pixels of the scale."""
    base = pixels.astype(float)
    shrunk = 1.0
    while base.size > MOST_PIXELS:
        base, shrunk = resize(_box(base, 1), base.shape[0] // 2, base.shape[1] // 2), shrunk * 2
    margin = RADIUS + 2
    for level in range(LEVELS):
        factor = 2 ** (level / 2)
        h, w = (round(n / factor) for n in base.shape)
        if min(h, w) < 2 * RADIUS + 8:
            return
        at = base if level == 0 else resize(_box(base, 1), h, w)
        smooth = _box(at, 1)
        gy, gx = np.gradient(smooth)
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        inner = (a * c - b * b - 0.05 * (a + c) ** 2)[margin:-margin, margin:-margin]
        y, x = np.nonzero((inner == _highest(inner)) & (inner > 1.0))
        tile = (y // TILE) * (inner.shape[1] // TILE + 1) + x // TILE
        order = np.lexsort((x, y, -np.round(inner[y, x], 6), tile))
        rank = np.arange(len(order)) - np.searchsorted(tile[order], tile[order])
        keep = np.sort(order[rank < PER_TILE])
        y, x = y[keep] + margin, x[keep] + margin
        near = smooth[y[:, None] + _DISC[:, 1], x[:, None] + _DISC[:, 0]]
        mean = near.mean(1)
        near = near - mean[:, None]
        vx, vy = near @ _DISC[:, 0], near @ _DISC[:, 1]
        turn = np.rint(np.arctan2(vy, vx) / (2 * np.pi) * TURNS).astype(int) % TURNS
        looks = np.stack([mean, np.hypot(vx, vy) / (_DISC[:, 0] ** 2).sum(), near.std(1) / 9], 1)
        yield level, factor * shrunk, _box(at, 3), x, y, turn, looks


def turned(pattern: np.ndarray) -> np.ndarray:
    """A pattern of tests (x, y, x, y) turned into each direction."""
    around = 2 * np.pi * np.arange(TURNS) / TURNS
    return np.stack([np.rint(np.concatenate([p @ np.array([[c, s], [-s, c]]) for p in (pattern[:, :2], pattern[:, 2:])], 1)) for c, s in zip(np.cos(around), np.sin(around))]).astype(int)


def outcomes(wide: np.ndarray, x: np.ndarray, y: np.ndarray, tests: np.ndarray) -> np.ndarray:
    return wide[y[:, None] + tests[:, :, 1], x[:, None] + tests[:, :, 0]] > wide[y[:, None] + tests[:, :, 3], x[:, None] + tests[:, :, 2]]


@lru_cache(maxsize=1)
def chosen_tests(pictures: int = 64, pool: int = 1500) -> np.ndarray:
    """The turned tests: of a random pool those nearest to even odds on generated pictures, none too much like another."""
    rng = np.random.default_rng(7)
    p = rng.uniform(-1, 1, (6 * pool, 4)) * (RADIUS - 1)
    inside = (np.hypot(p[:, 0], p[:, 1]) < RADIUS - 1) & (np.hypot(p[:, 2], p[:, 3]) < RADIUS - 1) & (np.hypot(p[:, 0] - p[:, 2], p[:, 1] - p[:, 3]) > 3)
    p = p[inside][:pool]
    around = turned(p)
    seen = np.concatenate([outcomes(wide, x, y, around[turn]) for i in range(pictures) for _, _, wide, x, y, turn, _ in corners(draw([float(-1 - i)]))]).astype(np.float32)
    odds = seen.mean(0)
    z = (seen - odds) / np.sqrt(odds * (1 - odds) + 1e-9)
    alike = np.abs(z.T @ z / len(z))
    for most in np.arange(0.4, 1.01, 0.05):
        picked: list[int] = []
        for j in np.argsort(np.abs(odds - 0.5), kind="stable").tolist():
            if len(picked) < TESTS and abs(odds[j] - 0.5) < 0.4 and (not picked or alike[j, picked].max() < most):
                picked.append(j)
        if len(picked) == TESTS:
            break
    # Dealt out, so that each part has some of the most even tests.
    return around[:, np.array(picked).reshape(8, -1).T.ravel()]


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of an image (level, turn, place in pixels of the image, tests) and their looks."""
    spots, looks = [np.zeros(0, _SPOT)], [np.zeros((0, 3), np.float16)]
    for level, factor, wide, x, y, turn, look in corners(pixels):
        found = np.zeros(len(x), _SPOT)
        found["level"], found["turn"], found["x"], found["y"] = level, turn, np.rint(x * factor), np.rint(y * factor)
        if len(x):
            found["bits"] = np.packbits(outcomes(wide, x, y, chosen_tests()[turn]), axis=1, bitorder="little").view("<u8")
        spots.append(found)
        looks.append(look.astype(np.float16))
    return np.concatenate(spots), np.concatenate(looks)


def entries_of(spots: np.ndarray, looks: np.ndarray) -> np.ndarray:
    """The distinct table entries of an image: 64-bit hashes of a corner's part of tests and of its sight of two others."""
    out = [np.zeros(0, np.uint64)]
    part = np.ascontiguousarray(spots["bits"]).view("u1").reshape(-1, 16).astype(np.uint64)
    mean, slope, spread = looks[:, 0].astype(float), np.maximum(looks[:, 1].astype(float), 0.05), np.maximum(looks[:, 2].astype(float), 0.05)
    rough = np.floor(np.log(spread / slope) / 0.4)

    def mixed(h: np.ndarray, k: int) -> np.ndarray:
        h = h * _MIX[k]
        return h ^ (h >> np.uint64(31))

    whole = lambda v: v.astype(np.int64).astype(np.uint64)
    for level in range(LEVELS):
        on = np.flatnonzero(spots["level"] == level)
        if len(on) < 3:
            continue
        xy = np.stack([spots["x"][on], spots["y"][on]], 1) / 2 ** (level / 2)
        k = min(NEAR, len(on) - 1)
        seen, far = np.zeros((len(on), k), int), np.zeros((len(on), k))
        for at in range(0, len(on), 1024):
            r = np.hypot(*(xy[None, :, a] - xy[at : at + 1024, None, a] for a in (0, 1)))
            r[r < APART] = np.inf
            seen[at : at + 1024] = np.argsort(r, 1, kind="stable")[:, :k]
            far[at : at + 1024] = np.take_along_axis(r, seen[at : at + 1024], 1)
        sights = []
        for c in range(k):
            i, j = on, on[seen[:, c]]
            d = xy[seen[:, c]] - xy
            toward = (np.arctan2(d[:, 1], d[:, 0]) / (2 * np.pi) * TURNS - spots["turn"][i]) % TURNS
            twist = (spots["turn"][j].astype(float) - spots["turn"][i] + 0.5) % TURNS
            r = np.where(np.isfinite(far[:, c]), far[:, c], APART)
            h = np.zeros(len(on), np.uint64)
            for v in (toward * 16 / TURNS, twist * 16 / TURNS, np.log(r / 4) / np.log(1.2), np.log(slope[i] / slope[j]) / 0.6, np.arctan((mean[i] - mean[j]) / 9 / (spread[i] + spread[j])) / np.pi * 12 + 12, rough[j]):
                h = mixed(h ^ whole(np.floor(v)), 0)
            sights.append(h)
        for a, b in combinations(range(k), 2):
            both = mixed(np.minimum(sights[a], sights[b]), 1) ^ mixed(np.maximum(sights[a], sights[b]), 2) ^ mixed(whole(rough[on]), 3)
            good = np.isfinite(far[:, a]) & np.isfinite(far[:, b])
            table = (both >> np.uint64(40)) % np.uint64(16)
            out.append(mixed(both ^ (part[on, table.astype(int)] * np.uint64(16) + table), 0)[good])
    return np.unique(np.concatenate(out))


def agreeing(u: np.ndarray, v: np.ndarray, distance: int = 16, least: int = 8) -> int:
    """How many distinct corners of two images agree on one scale, turn and shift (0 if fewer than ``least`` match at all)."""
    far = np.bitwise_count(u["bits"][:, None, 0] ^ v["bits"][None, :, 0]) + np.bitwise_count(u["bits"][:, None, 1] ^ v["bits"][None, :, 1])
    i, j = np.nonzero(far <= distance)
    if len(i) < least:
        return 0
    step = v["level"][j].astype(int) - u["level"][i]
    twist = (v["turn"][j].astype(int) - u["turn"][i]) % TURNS
    a, b = u["x"][i] + 1j * u["y"][i], v["x"][j] + 1j * v["y"][j]
    z = 2.0 ** (step / 2) * np.exp(2j * np.pi * twist / TURNS)
    small = np.minimum(1, 2.0 ** (-step / 2))
    votes, top = np.zeros(len(a), int), 0

    def voters(k: np.ndarray) -> np.ndarray:
        """Which matches agree with the proposals of the matches ``k``."""
        off = np.abs(b[None] - (b[k, None] + z[k, None] * (a[None] - a[k, None]))) * small[k, None]
        bend = (twist[None] - twist[k, None] + TURNS // 2) % TURNS - TURNS // 2
        return (off <= 8) & (np.abs(step[None] - step[k, None]) <= 1) & (np.abs(bend) <= TURNS // 16)

    for at in range(0, len(a), 512):
        votes[at : at + 512] = voters(np.arange(at, min(at + 512, len(a)))).sum(1)
    for k in np.argsort(-votes, kind="stable")[:5]:
        on = voters(np.array([k]))[0]
        bend = np.abs((twist - twist[k] + TURNS // 2) % TURNS - TURNS // 2) <= TURNS // 16
        for _ in range(2):
            if on.sum() < least:
                break
            ca, cb = a[on].mean(), b[on].mean()
            fit = ((b[on] - cb) * np.conj(a[on] - ca)).sum() / max((np.abs(a[on] - ca) ** 2).sum(), 1)
            if not 0.7 <= abs(fit / z[k]) <= 1.42:
                on = np.zeros(len(a), bool)
                break
            on = (np.abs(cb + fit * (a - ca) - b) <= 3.5 * max(abs(fit), 1)) & bend
        if on.sum() >= least:
            top = max(top, min(len(np.unique(np.rint(p[on] / 4))) for p in (a, b)))
    return top


def scan(images: DataFrame) -> DataFrame:
    """(image_id, sha, spots, looks) of each row: the SHA-256 of its bytes; spots are null for what is no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[bytes, tuple] = {}
        for b in slices(batches, 2 << 20):
            shas, found = [], []
            for raw in b.column("image").to_pylist():
                shas.append(hashlib.sha256(raw or b"").digest())
                if shas[-1] not in last:
                    if len(last) >= 64:
                        last.clear()
                    pixels = decode_pgm(raw)
                    last[shas[-1]] = (None, None) if pixels is None else tuple(x.tobytes() for x in describe(pixels))
                found.append(last[shas[-1]])
            spots, looks = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("image_id").cast(pa.int64()), *(pa.array(x, pa.binary()) for x in (shas, spots, looks))], ["image_id", "sha", "spots", "looks"])

    return images.select(F.col("image_id").cast("long").alias("image_id"), "image").mapInArrow(run, "image_id long, sha binary, spots binary, looks binary")


def _unpacked(spots: bytes, looks: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(spots, _SPOT), np.frombuffer(looks, np.float16).reshape(-1, 3)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values in a sorted array."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return start, np.diff(np.append(start, len(keys)))


def _within(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all members of the runs, one run after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def meetings(classes: DataFrame, buckets: int) -> DataFrame:
    """(u, v, n): how often u < v met by an entry of at most FEW images, or v the least image u of a larger entry; and a row
    (entry, null, -1) for each larger entry. A pair's n is partial: it is to be summed."""
    ROW, HUB, STAR = 0, 1, 2

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(nodes: list[int], entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            node = np.repeat(np.array(nodes, np.int64), [len(e) for e in entries])
            key = np.concatenate(entries)
            order = np.lexsort((node, key))
            node, key = node[order], key[order]
            start, size = _groups(key)
            big = size > LOCAL
            hub = np.repeat(node[start], size)
            rest = np.repeat(big, size)
            rest[start] = False
            kinds = [(ROW, key[~np.repeat(big, size)], node[~np.repeat(big, size)]), (HUB, key[start[big]], node[start[big]]), (STAR, hub[rest].view(np.uint64), node[rest])]
            low = min(nodes)
            rows = []
            for kind, k, n in kinds:
                to = (k >> np.uint64(11)) % np.uint64(buckets)
                o = np.argsort(to, kind="stable")
                at, many = _groups(to[o])
                rows += [(int(to[o[i]]), kind, low, k[o[i : i + m]].tobytes(), (n[o[i : i + m]] - low).astype("<u4").tobytes()) for i, m in zip(at.tolist(), many.tolist())]
            for at in range(0, len(rows), 16):
                cols = zip(*rows[at : at + 16])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "kind", "low", "keys", "nodes"])

        nodes: list[int] = []
        entries: list[np.ndarray] = []
        for b in slices(batches, 2 << 20):
            for node, spots, looks in zip(b.column("node").to_pylist(), b.column("spots").to_pylist(), b.column("looks").to_pylist()):
                if nodes and (len(nodes) >= BATCH or not 0 <= node - min(nodes) < 1 << 32 or node < nodes[0]):
                    yield from flush(nodes, entries)
                    nodes, entries = [], []
                nodes.append(node)
                entries.append(entries_of(*_unpacked(spots, looks)))
        if nodes:
            yield from flush(nodes, entries)

    def meet(t: pa.Table) -> pa.Table:
        parts: dict[int, list] = {ROW: [], HUB: [], STAR: []}
        for kind, low, k, n in zip(*(t.column(c).to_pylist() for c in ("kind", "low", "keys", "nodes"))):
            parts[kind].append((np.frombuffer(k, "<u8"), np.frombuffer(n, "<u4").astype(np.int64) + low))
        cat = lambda x, c, kind: np.concatenate([p[c] for p in x]) if x else np.zeros(0, kind)
        rows = parts[ROW] + parts[HUB]
        key, node = cat(rows, 0, np.uint64), cat(rows, 1, np.int64)
        marked = np.zeros(len(key), bool)
        marked[len(key) - sum(len(p[0]) for p in parts[HUB]) :] = True
        order = np.lexsort((node, key))
        key, node, marked = key[order], node[order], marked[order]
        start, size = _groups(key)
        large = (size > FEW) | (np.add.reduceat(marked, start) > 0) if len(start) else np.zeros(0, bool)
        u, v = [cat(parts[STAR], 0, np.uint64).view(np.int64)], [cat(parts[STAR], 1, np.int64)]
        for n in np.unique(size[~large & (size > 1)]).tolist():
            group = node[start[~large & (size == n)][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            u.append(group[:, i].ravel())
            v.append(group[:, j].ravel())
        at = _within(start[large], size[large])
        u.append(np.repeat(node[start[large]], size[large]))
        v.append(node[at])
        u, v = np.concatenate(u), np.concatenate(v)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, int)
        n = np.diff(np.append(first, len(u)))
        u, v = u[first], v[first]
        real = u != v
        keys = key[start[large]].view(np.int64)
        return pa.table({
            "u": pa.array(np.concatenate([u[real], keys])),
            "v": pa.concat_arrays([pa.array(v[real], pa.int64()), pa.nulls(len(keys), pa.int64())]),
            "n": pa.array(np.concatenate([n[real], np.full(len(keys), -1)]), pa.int64()),
        })

    sent = classes.select("node", "spots", "looks").where("spots is not null").mapInArrow(send, "bucket int, kind int, low long, keys binary, nodes binary")
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, "u long, v long, n long")


def verified(pairs: DataFrame, classes: DataFrame, distance: int, least: int, entries: int = 0) -> DataFrame:
    """The rows (u, v) of ``pairs`` that are copies, and share ``entries`` if that is given."""
    kept = ["spots", "looks"] if entries else ["spots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2 << 20):
            one, two = (list(zip(*(b.column(f"{side}_{c}").to_pylist() for c in kept))) for side in ("one", "two"))
            good = [agreeing(np.frombuffer(x[0], _SPOT), np.frombuffer(y[0], _SPOT), distance, least) >= least for x, y in zip(one, two)]
            if entries:
                good = [g and len(np.intersect1d(entries_of(*_unpacked(*x)), entries_of(*_unpacked(*y)))) >= entries for g, x, y in zip(good, one, two)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    spots = classes.where("spots is not null")
    one, two = (spots.select(F.col("node").alias(end), *(F.col(c).alias(f"{side}_{c}") for c in kept)) for end, side in (("u", "one"), ("v", "two")))
    return pairs.select("u", "v").join(one, "u").join(two, "v").mapInArrow(run, "u long, v long")


def shared_entries(held: DataFrame, large: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(entry, node, root) of the images ``held`` for each of the entries ``large`` that they have. Up to ``most`` entries are
    sent to all tasks; more are joined."""
    known = np.array(sorted(r["entry"] for r in large.collect()), np.int64) if large.count() <= most else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            found = [entries_of(*_unpacked(s, k)).view(np.int64) for s, k in zip(b.column("spots").to_pylist(), b.column("looks").to_pylist())]
            found = [x[np.isin(x, known)] for x in found] if known is not None else found
            size = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), b.column("node").take(size), b.column("root").take(size)], ["entry", "node", "root"])

    out = held.mapInArrow(rows, "entry long, node long, root long")
    return out if known is not None else out.join(large, "entry")


def across(classes: DataFrame, large: DataFrame, comps: DataFrame, entries: int, distance: int, least: int) -> DataFrame:
    """Copies (u, v) of different classes ``comps`` (u, root) that share one of the entries ``large`` (entry)."""
    held = classes.where("spots is not null").select("node", "spots", "looks")
    held = held.join(comps.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    shared = materialize(shared_entries(held, large), "large-entries")
    sizes = shared.groupBy("entry", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("entry").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = materialize(mixed.select("entry", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("strays")), "mixed-entries")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")

    # Few strays: each meets all others of the entry, which travel as arrays of a block.
    few = shared.join(mixed.where(F.col("strays") <= FEW), "entry")
    blocks = materialize(few.groupBy("entry", mine.alias("block")).agg(F.collect_list(F.struct("node", "root")).alias("others")), "entry-blocks")
    strays = few.where("root <> main").select("entry", F.col("node").alias("s"), F.col("root").alias("own"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen = None, set()
        for b in batches:
            u, v = [], []
            for s, own, others in zip(b.column("s").to_pylist(), b.column("own").to_pylist(), b.column("others").to_pylist()):
                if s != at:
                    at, seen = s, set()
                new = {x["node"] for x in others if x["root"] != own} - seen
                seen |= new
                u += [min(s, x) for x in new]
                v += [max(s, x) for x in new]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    met = strays.join(blocks, "entry").select("s", "own", "others").repartition("s").sortWithinPartitions("s").mapInArrow(meet, "u long, v long").distinct()
    thin = verified(materialize(met, "stray-pairs"), classes, distance, least, entries)

    # Many strays: pairs of blocks, compared in memory.
    dealt = shared.join(mixed.where(F.col("strays") > FEW), "entry").select("entry", "node", "root", "blocks", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("entry", "node", "root", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("pair"))
    dealt = dealt.join(held.select("node", "spots", "looks"), "node")

    def compare(t: pa.Table) -> pa.Table:
        node, root = t.column("node").to_numpy(), t.column("root").to_numpy()
        found = [_unpacked(s, k) for s, k in zip(t.column("spots").to_pylist(), t.column("looks").to_pylist())]
        keys = [entries_of(*x) for x in found]
        owner, key = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        owner, (start, size) = owner[order], _groups(key[order])
        edges = []
        by: list[list[np.ndarray]] = [[] for _ in keys]
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            members = owner[s : s + n]
            for i in range(n - 1):
                by[members[i]].append(members[i + 1 :])
        for i, others in enumerate(by):
            if others:
                j, n = np.unique(np.concatenate(others), return_counts=True)
                for x in j[(n >= entries) & (root[j] != root[i])].tolist():
                    if agreeing(found[i][0], found[x][0], distance, least) >= least:
                        edges.append((min(node[i], node[x]), max(node[i], node[x])))
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})

    return thin.unionByName(dealt.groupBy("entry", "pair").applyInArrow(compare, "u long, v long")).distinct()


def copies(images: DataFrame, entries: int = 2, distance: int = 16, least: int = 8) -> DataFrame:
    """(image_id, component_id, class_size, exact) of each row of ``images`` (image_id, image).

    component_id: the smallest image_id of its class; class_size: rows of the class; exact: how many rows have its bytes.
    Null and unreadable images, and those with fewer than three corners at each scale, form classes of equal bytes only; a
    null image_id belongs to the class of its bytes, whose id is null only if nothing else is in it; rows with one image_id
    and different bytes are different images; repeated rows are returned as they are; other columns are ignored; an empty
    table gives no rows.
    """
    spark = images.sparkSession
    rows = materialize(scan(images), "scanned-images")
    equal = rows.groupBy("sha").agg(F.min("image_id").alias("rep"), F.count("*").alias("exact"), F.first("spots").alias("spots"), F.first("looks").alias("looks"))
    classes = materialize(equal.withColumn("node", F.monotonically_increasing_id()), "image-classes")  # ids are fixed by the table
    buckets = max(partitions(spark), classes.count() * 800 // BUCKET + 1)
    met = materialize(meetings(classes, buckets), "meetings")
    pairs = materialize(met.where("v is not null").groupBy("u", "v").agg(F.sum("n").alias("n")).where(F.col("n") >= entries), "candidates")
    edges = materialize(verified(pairs, classes, distance, least), "copies")
    large = met.where("v is null").select(F.col("u").alias("entry")).distinct()
    if not large.isEmpty():
        comps = connected_components(edges, "u", "root")
        more = materialize(across(classes, large, comps, entries, distance, least), "copies-across")
        edges = edges.unionByName(more)
    release(met, pairs)
    comps = connected_components(edges, "node", "root")
    labels = materialize(classes.select("sha", "node", "rep", "exact").join(comps, "node", "left").withColumn("root", F.coalesce("root", "node")), "labels")
    whole = materialize(labels.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("exact").alias("class_size")), "image-components")
    labels = materialize(labels.join(whole, "root").select("sha", "component_id", "class_size", "exact"), "image-labels")
    return rows.select("image_id", "sha").join(labels, "sha").select("image_id", "component_id", "class_size", "exact")


def draw(vector: list[float], size: int = 96) -> np.ndarray:
    """A picture that a vector determines: overlapping rectangles of its own sizes, places and greys."""
    rng = np.random.default_rng(zlib.crc32(np.array(vector, "<f4").tobytes()))
    out = np.full((size, size), 128.0)
    for _ in range(45):
        x, y = rng.integers(-8, size, 2)
        w, h = rng.integers(6, 28, 2)
        out[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = rng.integers(0, 256)
    return out


def spin(pixels: np.ndarray, angle: float) -> np.ndarray:
    """Turned about its middle, black where nothing was."""
    h, w = pixels.shape
    y, x = np.mgrid[:h, :w] - np.array([(h - 1) / 2, (w - 1) / 2])[:, None, None]
    x, y = np.cos(angle) * x - np.sin(angle) * y + (w - 1) / 2, np.sin(angle) * x + np.cos(angle) * y + (h - 1) / 2
    inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
    x, y = np.clip(x, 0, w - 1.001), np.clip(y, 0, h - 1.001)
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    mixed = (pixels[i, j] * (1 - fx) + pixels[i, j + 1] * fx) * (1 - fy) + (pixels[i + 1, j] * (1 - fx) + pixels[i + 1, j + 1] * fx) * fy
    return np.where(inside, mixed, 0)


def edit(pixels: np.ndarray, seed: int) -> np.ndarray:
    """A cropped copy with other brightness and contrast; by the seed also quarter-turned, resized or turned by any angle."""
    rng = np.random.default_rng(seed)
    l, t, r, b = rng.integers(2, 14, 4)  # noqa: E741
    out = pixels[t : pixels.shape[0] - b, l : pixels.shape[1] - r] * rng.uniform(0.75, 1.0) + rng.uniform(0, 20)
    kind = int(rng.integers(0, 4))
    if kind == 1:
        out = np.rot90(out, int(rng.integers(1, 4)))
    elif kind == 2:
        by = rng.choice([0.75, 1.5, 2.0])
        out = resize(out, int(out.shape[0] * by), int(out.shape[1] * by))
    elif kind == 3:
        out = spin(out, rng.uniform(-np.pi, np.pi))
    return np.clip(np.rint(out), 0, 255)


def media_table(vectors: DataFrame) -> DataFrame:
    """(image_id, image): a picture for each row of ``vectors`` (vec_id, embedding). Rows whose vec_id leaves 5 when divided
    by 8 show an edited copy of the picture of the row before, where there is one: copies whose truth is known. A null
    vector makes a null image."""
    own = vectors.select("vec_id", "embedding")
    before = own.groupBy((F.col("vec_id") + 1).alias("vec_id")).agg(F.min("embedding").alias("source")).where("vec_id % 8 = 5")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            out = []
            for i, v, s in zip(*(b.column(c).to_pylist() for c in ("vec_id", "embedding", "source"))):
                finite = [x if x is not None else 0.0 for x in (s if s is not None else v) or []]
                pixels = draw(finite) if (s if s is not None else v) is not None else None
                out.append(None if pixels is None else encode_pgm(edit(pixels, i) if s is not None else pixels))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(out, pa.binary())], ["image_id", "image"])

    return own.join(before, "vec_id", "left").mapInArrow(run, "image_id long, image binary")
