"""Product codes of vectors: a codebook per part, fitted by k-means over metric trees of the parts.

Vectors are cut into parts; every part position has its own codebook, fitted by rounds of assigning and averaging in
whole numbers, so that results don't depend on how rows are dealt to tasks. Vectors are dealt into blocks
of a bounded number, and each block keeps one tree per part position, built once and read in every round.

A tree is an anchors hierarchy, built middle-out: about sqrt(n) anchors are chosen, each the point farthest from its
own anchor, and steal the points that are nearer to them (the triangle inequality says which can't be); each
anchor's points become a ball, large balls are divided the same way, and the anchors' balls are merged pair by pair,
the tightest first, up to one root. Every ball caches the sum and the count of its points.

A round walks down from the root with a list of candidate entries that shrinks on the way: an entry leaves once some
other one is nearer to every point of the ball. With one entry left the ball is wholly owned and its cached sum
and count are all that is needed; only the points of undecided leaves are compared one by one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import materialise

SCALE = 4096
#: Components beyond this are held at it: sums of them still fit a decimal of 38 digits.
LARGEST = 10**24
#: Up to here distances and sums of a block are exact in 64 bits, given parts of up to 2**12 components.
SMALL = 1 << 24
LONG_MAX = (1 << 63) - 1


def whole_numbers(vector: np.ndarray) -> list[int] | np.ndarray:
    """floor(4096 * x) of finite components."""
    scaled = np.floor(vector * float(SCALE))
    if np.abs(scaled).max(initial=0) <= SMALL:
        return scaled.astype(np.int64)
    return [max(-LARGEST, min(LARGEST, math.floor(float(x)) * SCALE if abs(x) > 2.0**53 else math.floor(float(x) * SCALE))) for x in vector]


def parts_of(size: int, parts: int) -> list[tuple[int, int]]:
    """Consecutive parts, equal where ``parts`` divides ``size``, else within one component of it."""
    return [(p * size // parts, (p + 1) * size // parts) for p in range(parts)]


class Tree:
    """Balls over points in tree order: ``start, end`` of its points, ``left, right`` child or -1, pivot, radius, sum.

    Pivot and radius are floating-point and steer the walk only; ``sums`` are exact.
    """

    FIELDS = (("start", "i4"), ("end", "i4"), ("left", "i4"), ("right", "i4"), ("radius", "f8"), ("pivot", "f8"), ("sums", "i8"))

    def __init__(self, order: np.ndarray, **arrays: np.ndarray):
        self.order = order
        self.__dict__.update(arrays)

    def dump(self) -> dict[str, bytes]:
        return {"order": self.order.astype("i4").tobytes(), **{n: getattr(self, n).astype(k).tobytes() for n, k in self.FIELDS}}

    @classmethod
    def load(cls, stored: dict[str, bytes], width: int) -> Tree:
        arrays = {n: np.frombuffer(stored[n], dtype=k) for n, k in cls.FIELDS}
        for n in ("pivot", "sums"):
            arrays[n] = arrays[n].reshape(len(arrays["start"]), width)
        return cls(np.frombuffer(stored["order"], dtype="i4"), **arrays)


class _Builder:
    """Builds the tree of one part of one block."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points.astype(float), leaf
        self.exact = points
        self.balls: list[tuple] = []  # (members, left, right)

    def anchors(self, members: np.ndarray) -> list[np.ndarray]:
        """The members dealt to about sqrt(n) anchors; fewer where points coincide."""
        x = self.points[members]
        owner = np.zeros(len(x), dtype=np.int64)
        far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        centres = x[:1]
        for number in range(1, math.isqrt(len(x) - 1) + 1):
            at = int(far.argmax())
            if far[at] == 0:
                break
            apart = np.sqrt(((centres - x[at]) ** 2).sum(axis=1))
            # A point nearer to its anchor than half the way to the new one can't be stolen.
            near = np.flatnonzero(2 * far > apart[owner] * (1 - 1e-12))
            to_new = np.sqrt(((x[near] - x[at]) ** 2).sum(axis=1))
            stolen = to_new < far[near]
            owner[near[stolen]], far[near[stolen]] = number, to_new[stolen]
            centres = np.vstack([centres, x[at]])
        by_owner = np.argsort(owner, kind="stable")
        return [m for m in np.split(members[by_owner], np.cumsum(np.bincount(owner))[:-1]) if len(m)]

    def ball(self, members: np.ndarray, left: int = -1, right: int = -1) -> int:
        self.balls.append((members, left, right))
        return len(self.balls) - 1

    def build(self, members: np.ndarray) -> int:
        if len(members) <= self.leaf:
            return self.ball(members)
        groups = self.anchors(members)
        if len(groups) == 1:  # all points coincide
            return self.ball(members)
        nodes = [self.build(g) for g in groups]
        return self.merge(nodes)

    def merge(self, nodes: list[int]) -> int:
        """Join balls two at a time, the pair with the smallest common ball first."""
        members = [self.balls[i][0] for i in nodes]
        pivot = np.array([self.points[m].mean(axis=0) for m in members])
        radius = np.array([np.sqrt(((self.points[m] - c) ** 2).sum(axis=1).max()) for m, c in zip(members, pivot)])
        apart = np.sqrt(((pivot[:, None] - pivot[None]) ** 2).sum(axis=2))
        size = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        np.fill_diagonal(size, np.inf)
        nodes, count = list(nodes), np.array([len(m) for m in members], dtype=float)
        last = nodes[0]
        for _ in range(len(nodes) - 1):
            i, j = sorted(divmod(int(size.argmin()), len(size)))
            joined = np.concatenate([self.balls[nodes[i]][0], self.balls[nodes[j]][0]])
            last = nodes[i] = self.ball(joined, nodes[i], nodes[j])
            pivot[i] = (pivot[i] * count[i] + pivot[j] * count[j]) / (count[i] + count[j])
            count[i] += count[j]
            radius[i] = size[i, j]
            apart = np.sqrt(((pivot - pivot[i]) ** 2).sum(axis=1))
            wide = np.maximum((apart + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
            gone = np.isinf(size[i]) | np.isinf(size[:, i])
            gone[j] = True
            wide[gone] = np.inf
            size[i], size[:, i] = wide, wide
            size[j], size[:, j] = np.inf, np.inf
        return last

    def tree(self) -> Tree:
        """Balls in walking order (parents first), points so that every ball's members lie together."""
        root = self.build(np.arange(len(self.points)))
        at, queue = {}, [root]
        for node in queue:
            at[node] = len(at)
            queue += [k for k in self.balls[node][1:] if k >= 0]
        order, place = [], {}
        stack = [root]
        n = 0
        while stack:  # leaves from left to right
            node = stack.pop()
            members, left, right = self.balls[node]
            place[node] = n
            if left < 0:
                order.append(members)
                n += len(members)
            else:
                stack += [right, left]
        start = np.array([place[i] for i in queue])
        size = np.array([len(self.balls[i][0]) for i in queue])
        child = np.array([[at.get(k, -1) for k in self.balls[i][1:]] for i in queue])
        sums = np.array([self.exact[self.balls[i][0]].sum(axis=0) for i in queue])
        pivot = sums / size[:, None]
        radius = np.array([np.sqrt(((self.points[self.balls[i][0]] - c) ** 2).sum(axis=1).max()) for i, c in zip(queue, pivot)])
        return Tree(
            np.concatenate(order), start=start, end=start + size, left=child[:, 0], right=child[:, 1],
            radius=radius, pivot=pivot, sums=sums,
        )


def build_tree(points: np.ndarray, leaf: int = 24) -> Tree:
    return _Builder(points, leaf).tree()


def nearest(points: np.ndarray, entries: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, exact, ties to the lower index."""
    gap = np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)
    if allowed is not None:
        gap = np.where(allowed, gap, np.iinfo(np.int64).max)
    best = gap.argmin(axis=1)
    return best, gap[np.arange(len(points)), best]


def walk(tree: Tree, points: np.ndarray, entries: np.ndarray, owned, undecided) -> None:
    """Call ``owned(balls, entry of each)`` and ``undecided(places of points, their nearest entries)`` over the tree.

    All balls of a depth are looked at together. ``points`` are in tree order.
    """
    spots = entries.astype(float)
    balls, listed = np.zeros(1, dtype=np.int64), np.ones((1, len(entries)), dtype=bool)
    while len(balls):
        gap = np.sqrt(((tree.pivot[balls][:, None] - spots[None]) ** 2).sum(axis=2))
        reach = tree.radius[balls][:, None]
        # Strictly farther for all points of the ball, with room for rounding.
        worst = np.where(listed, gap + reach, np.inf).min(axis=1, keepdims=True)
        listed = listed & (gap - reach <= worst + 1e-9 * (gap + reach + 1))
        alone = listed.sum(axis=1) == 1
        owned(balls[alone], listed[alone].argmax(axis=1))
        leaf = ~alone & (tree.left[balls] < 0)
        if leaf.any():
            size = tree.end[balls[leaf]] - tree.start[balls[leaf]]
            spot = np.repeat(tree.start[balls[leaf]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            undecided(spot, nearest(points[spot], entries, np.repeat(listed[leaf], size, axis=0))[0])
        inner = ~alone & ~leaf
        balls = np.concatenate([tree.left[balls[inner]], tree.right[balls[inner]]])
        listed = np.concatenate([listed[inner], listed[inner]])


def tallies(tree: Tree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sum and count of the points that are nearest to each entry."""
    sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)

    def owned(balls, entry):
        np.add.at(sums, entry, tree.sums[balls])
        np.add.at(counts, entry, tree.end[balls] - tree.start[balls])

    def undecided(spot, entry):
        np.add.at(sums, entry, points[spot])
        np.add.at(counts, entry, 1)

    walk(tree, points, entries, owned, undecided)
    return sums, counts


def assigned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every point, in the block's own order."""
    code = np.zeros(len(points), dtype=np.int64)

    def owned(balls, entry):
        size = tree.end[balls] - tree.start[balls]
        spot = np.repeat(tree.start[balls] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        code[spot] = np.repeat(entry, size)

    def undecided(spot, entry):
        code[spot] = entry

    walk(tree, points, entries, owned, undecided)
    back = np.empty_like(code)
    back[tree.order] = code
    return back


Codebooks = dict[int, list[np.ndarray]]

BLOCK = "size int, small boolean, keys array<long>, labels array<string>, points binary, trees array<struct<" + ", ".join(
    f"{n}:binary" for n in ("order", *(n for n, _ in Tree.FIELDS))
) + ">>"


def _blocks(vectors: DataFrame, parts: int, block: int) -> DataFrame:
    """Blocks of up to ``block`` vectors of one size with a tree per part, written to the shared folder."""

    def one(size: int, rows: list[tuple]) -> pa.RecordBatch:
        small = all(isinstance(r[2], np.ndarray) for r in rows)
        keys, labels = [r[0] for r in rows], [r[1] for r in rows]
        if small:
            points = np.array([r[2] for r in rows], dtype=np.int64).reshape(len(rows), size)
            trees = [build_tree(points[:, i:j]).dump() for i, j in parts_of(size, parts)]
            raw = points.astype("i4").tobytes()
        else:  # beyond 64-bit distances: decimal numbers, compared one by one
            trees, raw = [], ",".join(str(int(x)) for r in rows for x in r[2]).encode()
        values = [[size], [small], [keys], [labels], [raw], [trees]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    schema = pa.schema(
        [
            ("size", pa.int32()),
            ("small", pa.bool_()),
            ("keys", pa.list_(pa.int64())),
            ("labels", pa.list_(pa.string())),
            ("points", pa.binary()),
            ("trees", pa.list_(pa.struct([(n, pa.binary()) for n in ("order", *(n for n, _ in Tree.FIELDS))]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list] = {}
        n = 0
        for batch in batches:
            for key, label, vector in zip(*batch.columns, strict=True):
                numbers = whole_numbers(np.array(vector.as_py(), dtype=float))
                kind = (len(numbers), isinstance(numbers, np.ndarray))
                rows = waiting.setdefault(kind, [])
                rows.append((key.as_py(), label.as_py(), numbers))
                n += 1
                if len(rows) >= block or n >= 4 * block:
                    if len(rows) < block:  # many sizes at once: the largest block leaves early
                        kind = max(waiting, key=lambda k: len(waiting[k]))
                    n -= len(waiting[kind])
                    yield one(kind[0], waiting.pop(kind))
        for kind, rows in waiting.items():
            yield one(kind[0], rows)

    return materialise(vectors.mapInArrow(run, BLOCK), "balls")


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(size, keys, labels, points, trees) of each block."""
    for i in range(batch.num_rows):
        size, small, keys, labels, raw, trees = (c[i].as_py() for c in batch.columns)
        if small:
            points = np.frombuffer(raw, dtype="i4").astype(np.int64).reshape(len(keys), size)
        else:
            points = np.array([int(x) for x in raw.decode().split(",")], dtype=object).reshape(len(keys), size)
        yield size, keys, labels, points, trees


def _one_by_one(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest`, for numbers of any size."""
    gap = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points]
    best = np.array([row.index(min(row)) for row in gap], dtype=np.int64)
    return best, np.array([row[b] for row, b in zip(gap, best, strict=True)], dtype=object)


def _fits(points: np.ndarray, entries: np.ndarray) -> bool:
    return points.dtype != object and (entries.dtype != object or np.abs(entries).max(initial=0) <= SMALL)


def first_entries(vectors: DataFrame, parts: int, k: int) -> Codebooks:
    """The parts of the ``k`` smallest keys of each size; repeated keys by their vectors, null keys last."""
    first = Window.partitionBy("size").orderBy(F.col("key").asc_nulls_last(), "vector")
    rows = vectors.withColumn("size", F.size("vector")).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k)
    found: dict[int, list] = {}
    for row in rows.orderBy("size", "_n").collect():  # k rows for every length of vector
        found.setdefault(row["size"], []).append([int(x) for x in whole_numbers(np.array(row["vector"], dtype=float))])
    return {
        size: [_entries([r[i:j] for r in rows]) for i, j in parts_of(size, parts)] for size, rows in found.items()
    }


def _entries(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) <= SMALL for r in rows for x in r)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), len(rows[0]))


def fit(blocks: DataFrame, books: Codebooks, parts: int, rounds: int) -> Codebooks:
    """``rounds`` of assigning all parts and averaging them; entries without parts stay.

    A round reads every tree once. What meets are the tallies of blocks, combined before the
    shuffle; the driver holds codebooks, whose size depends on the vectors' length alone.
    """
    for _ in range(rounds):
        here = books

        def run(batches: Iterator[pa.RecordBatch], here: Codebooks = here) -> Iterator[pa.RecordBatch]:
            out: dict[tuple, list] = {}
            for batch in batches:
                for size, _, _, points, trees in _read(batch):
                    for part, (i, j) in enumerate(parts_of(size, parts)):
                        entries = here[size][part]
                        if _fits(points, entries):
                            tree = Tree.load(trees[part], j - i)
                            sums, counts = tallies(tree, points[tree.order, i:j], entries.astype(np.int64))
                        else:
                            best = _one_by_one(points[:, i:j], entries)[0]
                            counts = np.bincount(best, minlength=len(entries))
                            sums = [points[best == e, i:j].astype(object).sum(axis=0) for e in range(len(entries))]
                        for e in np.flatnonzero(counts):
                            held = out.setdefault((size, part, int(e)), [0, [0] * (j - i)])
                            held[0] += int(counts[e])
                            held[1] = [a + int(b) for a, b in zip(held[1], sums[e], strict=True)]
            names = ["size", "part", "entry", "n", "sums"]
            rows = [(*key, n, [str(s) for s in sums]) for key, (n, sums) in out.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate([pa.int32()] * 3 + [pa.int64(), pa.list_(pa.string())])],
                names=names,
            )

        tallied = blocks.mapInArrow(run, "size int, part int, entry int, n long, sums array<string>")
        place = tallied.select("size", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "sum"))
        total = place.groupBy("size", "part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")
        )
        moved: dict[tuple, dict[int, int]] = {}
        for row in total.collect():  # one number for each component of the codebooks
            at = moved.setdefault((row["size"], row["part"], row["entry"]), {})
            if row["at"] is not None:
                at[row["at"]] = int(row["sum"]) // row["n"]
        books = {
            size: [
                _entries([[moved.get((size, p, e), {}).get(c, int(x)) for c, x in enumerate(row)] for e, row in enumerate(book)])
                for p, book in enumerate(parts_books)
            ]
            for size, parts_books in books.items()
        }
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for row in b for x in row).encode()).hexdigest()


def encode(
    df: DataFrame, key: str, vector: str, label: str, parts: int = 8, entries: int = 16, rounds: int = 6, block: int = 4096
) -> DataFrame:
    """``key, label, code, error, label_error, codebooks_sha256`` for every row with a usable vector.

    Vectors that are null or hold null or non-finite components are left out; rows are otherwise kept one for one,
    repeated ones too. Components become floor(4096 * x). Codebooks start as the parts of the ``entries`` smallest
    keys (fewer where there are fewer rows) and are averaged ``rounds`` times. ``code`` has two hexadecimal
    digits a part; ``error`` is the squared distance to the chosen entries over all parts, at most the
    largest long; ``label_error`` adds it over equal labels, nulls together. Vectors of one length share
    codebooks, other lengths have their own; lengths that ``parts`` doesn't divide are cut as evenly as they can be, and empty
    vectors have empty parts (code 0, error 0). Components are held within 1e24. Extra columns are not returned.
    """
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(vector).isNotNull()).filter(usable)
    rows = rows.select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    kind = df.schema[label].dataType
    blocks = _blocks(rows, parts, block)
    books = fit(blocks, first_entries(rows, parts, entries), parts, rounds)
    digests = {size: digest(b) for size, b in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, keys, labels, points, trees in _read(batch):
                codes, error = [], np.zeros(len(keys), dtype=object)
                for part, (i, j) in enumerate(parts_of(size, parts)):
                    book = books[size][part]
                    if _fits(points, book):
                        tree, book = Tree.load(trees[part], j - i), book.astype(np.int64)
                        best = assigned(tree, points[tree.order, i:j], book)
                        error += ((points[:, i:j] - book[best]) ** 2).sum(axis=1)
                    else:
                        best, gap = _one_by_one(points[:, i:j], book)
                        error += gap
                    codes.append(best)
                text = [bytes(row).hex() for row in np.array(codes, dtype=np.uint8).T]
                columns = [keys, labels, text, [min(int(e), LONG_MAX) for e in error], [digests[size]] * len(keys)]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["key", "label", "code", "error", "codebooks_sha256"],
                )

    coded = materialise(
        blocks.mapInArrow(run, "key long, label string, code string, error long, codebooks_sha256 string"), "codes"
    )
    total = coded.groupBy("label").agg(
        F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX)).cast("long").alias("label_error")
    )
    named = total.select(F.col("label").alias("_label"), "label_error")
    out = coded.join(named, F.col("label").eqNullSafe(F.col("_label")))
    return out.select(
        F.col("key").alias(key), F.col("label").cast(kind).alias(label), "code", "error", "label_error", "codebooks_sha256"
    )
