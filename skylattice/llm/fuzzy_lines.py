"""Fuzzy line dedup by MinHash: character shingles, high-recall bands, exact Jaccard verification, one line kept per component.

A line is compared in lower case with its white space as single spaces. Its shingles are all runs of SHINGLE characters (a shorter
line is one shingle): 4, so that lines of 40 characters with one of them changed are at 0.8. Each shingle is hashed once, to one of
PLACES places and a value; a place keeps its least value, and a place that no shingle fell on takes that of the first place of its
own random order that has one. Two lines so agree at a place with a chance that is exactly their Jaccard similarity. Lines share many
short shingles by chance (lines of 1,000 characters of one language up to a quarter), so bands have ROWS = 9 places: BANDS of them
make lines at similarity 0.8 candidates with a chance of 98.7 %, at 0.85 of 99.96 %, and strangers at 0.25 with a chance of 1e-4.

Candidates are verified on their exact shingle sets (0.8 or more), components come from distributed union-find, and of all lines of
a component, exact copies included, only the first in order of doc_id, then line number, stays. Equal lines (by a 128-bit key) are
one item from the start, and a task sketches such a line once.

Defined results: blank lines are never compared and always stay; what stays is not altered. Null text stays null, empty text empty;
a text that loses all its lines becomes empty. Rows that repeat doc_id and text are one document: alike in what they keep. Null
ids come last. An empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice import runtime
from skylattice.llm.hashing import BASE, ELEMENT, ELEMENT_BITS, banded, mix
from skylattice.llm.memo import Memo
from skylattice.llm.near_groups import BANDED, banded_rows, bucket_pairs, near_groups, numbered, packed, parts_for, unpacked
from skylattice.llm.rows import with_row

SHINGLE = 4
BANDS, ROWS = 30, 9
PLACES = BANDS * ROWS
LEAST = 0.8
#: Characters sketched at once, so that very long texts need little memory.
CHUNK = 1 << 16
#: Lines (about) whose band rows a task makes at once, and lines it remembers as sketched.
LINES, SEEN = 10_000, 500_000
#: Bytes that a line is taken to have where only the size of tasks depends on it.
BYTES = 256
#: Lines of a block of a bucket: a few hundred bytes each.
BLOCK = 512
#: Lines to verify up to this number are fetched with broadcast ids (some 50 bytes each); more of them by a shuffle.
FEW = 500_000
#: Schema of entries(), and as Arrow's.
ENTRIES = f"{BANDED}, places binary"
EMPTY = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("band", "key", "head", "places"))])
#: A place as it is packed: the two halves of content and of row, doc_id (`no_id` 1: null), line, and how often its batch has the content (0: not its first place there).
PLACE = np.dtype([(c, ">u8") for c in ("c1", "c2", "r1", "r2")] + [("doc_id", "<i8"), ("line", "<i4"), ("n", "<i4"), ("no_id", "u1")])
#: Schema of gathered(), and as Arrow's.
GATHERED = "band long, a long, b long, content binary, key long, row binary, doc_id long, line int, n int"
MADE = pa.schema([("band", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("content", pa.binary()), ("key", pa.int64()), ("row", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32()), ("n", pa.int32())])
#: White space other than the space and the line feed.
ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
ODD_ASCII = [c for c in ODD if c.isascii()]
#: For each place the order in which it looks at all places for a value, itself first.
ORDERS = np.argsort(np.random.default_rng(4).random((PLACES, PLACES)) + 1 - np.eye(PLACES), axis=1)
#: RANKS[i, j]: when the place j looks at the place i.
RANKS = np.argsort(ORDERS, axis=1).T.astype(np.uint16).copy()
#: A line with values at so many places or fewer has its others filled by the least rank, any other by looking in turn; lines filled at once, to stay in the cache.
SPARSE, TOGETHER = 16, 256
#: Turns, the first a place's own, in which all places look at once; then those look that are still without a value.
TURNS = 4


def is_odd(text: str) -> bool:
    """True if the text has white space other than spaces and line feeds."""
    return any(c in text for c in (ODD_ASCII if text.isascii() else ODD))


def plain(line: str) -> str:
    """What is compared of a line."""
    low = line.lower()
    return " ".join(low.split()) if is_rough(low) or "\n" in low or is_odd(low) else low


def is_rough(line: str) -> bool:
    """True if a line has a space beside another, or at an end."""
    return "  " in line or line[:1] == " " or line[-1:] == " "


def plain_lines(text: str) -> list[str]:
    """plain() of every line of a text; what holds for the text needn't be looked for in each line, and no line sways the lower case of another."""
    low = text.lower()
    lines = low.split("\n")
    if is_odd(low):
        return [" ".join(x.split()) for x in lines]
    if "  " in low:
        return [" ".join(x.split()) if is_rough(x) else x for x in lines]
    return [x.strip() if x[:1] == " " or x[-1:] == " " else x for x in lines]


def key_of(line: str) -> bytes:
    """A 128-bit key of a plain line."""
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def short(contents: bytes) -> np.ndarray:
    """48 bits of each 128-bit key."""
    return np.frombuffer(contents, np.int64)[::2] & int(ELEMENT)


def shingles(line: str) -> set[str]:
    """The shingle set of a plain line."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of all (plain, not empty) lines, in order, and the number of shingles of each line."""
    sizes = np.array([len(x) for x in lines])
    # padding keeps the shingles of a short line within it: it has one, which reaches into its own padding
    padded = np.maximum(sizes, SHINGLE)
    text = "".join(x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines)
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for width in (1, 2):  # hashes of runs of 2, 4 characters
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
    counts = padded - SHINGLE + 1
    ends = np.cumsum(padded)
    inside = np.ones(len(text), bool)
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    return mix(h[inside[: len(h)]]), counts


def filled(best: np.ndarray) -> np.ndarray:
    """best, a row a line, with the places that have no value (the largest number) filled from the first in their order that has one; each row has one at least."""
    none = ~np.uint64(0)
    there = best != none
    counts = there.sum(1)
    # lines with as many values are filled together
    order = np.argsort(counts, kind="stable")
    edges = np.searchsorted(counts[order], np.arange(1, SPARSE + 2))
    for n in range(1, SPARSE + 1):
        for a in range(edges[n - 1], edges[n], TOGETHER):
            some = order[a : min(a + TOGETHER, edges[n])]
            at = np.nonzero(there[some])[1].reshape(len(some), n)
            best[some] = np.take_along_axis(best[some], np.take_along_axis(at, RANKS[at].argmin(1), 1), 1)
    turns = ORDERS.ravel()
    for a in range(edges[SPARSE], len(order), TOGETHER):
        some = order[a : a + TOGETHER]
        source = best[some]
        across = made = np.ascontiguousarray(source.T)  # a row a place, so that whole rows are copied
        for nth in range(1, TURNS):
            made = np.where(made == none, across.take(ORDERS[:, nth], axis=0), made)
        source, made = source.ravel(), made.T.ravel()
        empty = np.flatnonzero(made == none)
        start, orders, nth = empty - empty % PLACES, empty % PLACES * PLACES, TURNS - 1
        while len(empty):
            nth += 1
            value = source.take(start + turns.take(orders + nth))
            made[empty] = value
            left = np.flatnonzero(value == none)
            empty, start, orders = empty[left], start[left], orders[left]
        best[some] = made.reshape(-1, PLACES)
    return best


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, PLACES) of 64-bit values."""
    # a long line is sketched in segments that share SHINGLE - 1 characters
    step = CHUNK - SHINGLE + 1
    parts = [(i, x[a : a + CHUNK]) for i, x in enumerate(lines) for a in range(0, max(1, len(x) - SHINGLE + 1), step)]
    best = np.full(len(lines) * PLACES, ~np.uint64(0))
    a, size = 0, 0
    for b, (_, x) in enumerate(parts, 1):
        size += len(x)
        if size >= CHUNK or b == len(parts):
            hashes, counts = shingle_hashes([x for _, x in parts[a:b]])
            of = np.repeat(np.array([i * PLACES for i, _ in parts[a:b]]), counts)
            place = ((hashes >> np.uint64(32)) * np.uint64(PLACES) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, of + place, hashes * np.uint64(BASE) >> np.uint64(1))
            a, size = b, 0
    return filled(best.reshape(-1, PLACES))


def entries(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of ENTRIES, dealt into so many parts, in one pass over the texts; docs: row, doc_id, text. There are three kinds:

    near_groups.BANDED rows of the lines that aren't blank, each line once from a task (or once more, if it comes back very late);
    by parts of the content (the 128-bit key), the first place of each line of a batch and how often it has it, in n;
    the other places, without n, dealt to parts in turn, so that a line of all texts fills no part.
    """

    def banded_lines(keys: list[bytes], lines: list[str]) -> pa.RecordBatch:
        made = banded_rows(short(b"".join(keys)), banded(signatures(lines), ROWS), parts)
        return pa.RecordBatch.from_arrays([*made.columns, pa.nulls(len(made), pa.binary())], schema=EMPTY)

    def placed(content: list[bytes], of: list[int], number: list[int], row: pa.Array, doc_id: pa.Array, turn: int) -> pa.RecordBatch:
        """The places of a batch's lines that aren't first in one row, then the first place of each line, a row for each part."""
        made = np.zeros(len(of), PLACE)
        made["c1"], made["c2"] = np.frombuffer(b"".join(content), ">u8").reshape(-1, 2).T
        made["r1"], made["r2"] = np.frombuffer(b"".join(row.to_pylist()), ">u8").reshape(-1, 2)[of].T
        made["doc_id"], made["no_id"] = np.asarray(doc_id.fill_null(0))[of], np.asarray(doc_id.is_null())[of]
        made["line"], made["n"] = number, 1
        first, rest = firsts(made)
        part = ((first["c1"].astype(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        edges = np.concatenate([[0], len(rest) + starts, [len(of)]])
        nothing = pa.nulls(len(starts) + 1, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.append(turn % parts, part[starts])), nothing, nothing, nothing, packed(np.concatenate([rest, first]), edges)], schema=EMPTY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, keys, lines, turn = Memo(lambda key: [], SEEN), [], [], TaskContext.get().partitionId() * 101
        for batch in batches:
            content, of, number = [], [], []
            for n, text in enumerate(batch.column(2).to_pylist()):
                for i, line in enumerate(plain_lines(text) if text else ()):
                    if line:
                        key = key_of(line)
                        content.append(key)
                        of.append(n)
                        number.append(i)
                        if not (mark := seen[key]):
                            mark.append(True)
                            keys.append(key)
                            lines.append(line)
            if content:
                turn += 1
                yield placed(content, of, number, batch.column(0), batch.column(1), turn)
            if len(lines) >= LINES:
                yield banded_lines(keys, lines)
                keys, lines = [], []
        if lines:
            yield banded_lines(keys, lines)

    return docs.select("row", "doc_id", "text").mapInArrow(run, ENTRIES)


def firsts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of PLACEs the first of each content in order of doc_id (nulls last), row, line, with the sum of n, sorted by content; then the others, with n 0."""
    c1 = places["c1"].astype(np.uint64)
    order = np.argsort(c1)
    same = c1[order[1:]] == c1[order[:-1]]
    # few lines come again: only these are put in order
    again = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if len(same) else np.zeros(0, np.int64)
    some = places[order[again]]
    order[again] = order[again][np.lexsort([some[c].astype(some[c].dtype.newbyteorder("=")) for c in ("line", "r2", "r1", "doc_id", "no_id", "c2", "c1")])]
    places = places[order]
    is_first = np.ones(len(places), bool)
    is_first[1:] = (places["c1"][1:] != places["c1"][:-1]) | (places["c2"][1:] != places["c2"][:-1])
    first, rest = places[is_first], places[~is_first]
    if len(first):
        first["n"] = np.add.reduceat(places["n"], np.flatnonzero(is_first))
    rest["n"] = 0
    return first, rest


def gathered(rows: DataFrame, twice: bool = True) -> DataFrame:
    """Rows of GATHERED, of rows of ENTRIES: candidates (band, a, b), the first place of each content (with key, 48 bits of it, and n), and the
    other places without n; if `twice`, all places without n, the first among them."""

    def halves(places: np.ndarray, one: str, two: str) -> pa.Array:
        both = np.column_stack([places[one], places[two]])
        return packed(both, np.arange(len(places) + 1))

    def columns(places: np.ndarray, first: bool) -> pa.Table:
        content = halves(places, "c1", "c2")
        made = {"content": content, "row": halves(places, "r1", "r2"), "line": pa.array(places["line"])}
        if first:
            made |= {"key": pa.array(short(np.column_stack([places["c1"], places["c2"]]).tobytes())), "doc_id": pa.array(places["doc_id"], mask=places["no_id"] > 0), "n": pa.array(places["n"])}
        return pa.table(made)

    def run(table: pa.Table) -> pa.Table:
        places = unpacked(table.column("places"), PLACE)
        settled = places["n"] == 0
        first, rest = firsts(places[~settled])
        pairs = bucket_pairs(table.filter(pa.compute.is_valid(table.column("band"))))
        kinds = [pa.table(dict(zip(("band", "a", "b"), map(pa.array, pairs)))), columns(first, True), *(columns(x, False) for x in (places[settled], rest, *[first] * twice))]
        return pa.concat_tables([pa.table([t.column(f.name) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in MADE], schema=MADE) for t in kinds])

    return rows.groupBy("part").applyInArrow(run, GATHERED)


def portions(lines: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The lines in order, in portions of at least `most` characters or, the last, fewer."""
    a = size = 0
    for b, x in enumerate(lines, 1):
        size += len(x or "") + 1
        if size >= most or b == len(lines):
            yield lines[a:b]
            a, size = b, 0


def shingle_ids(lines: list[str | None]) -> list[np.ndarray]:
    """The shingle set of each line as sorted 48-bit hashes."""
    found = []
    for some in portions(lines, CHUNK):
        hashes, counts = shingle_hashes([x or " " for x in plain_lines("\n".join(x or "" for x in some))])
        hashes &= ELEMENT
        ends = np.cumsum(counts)
        for i, j in zip([0, *ends.tolist()], ends.tolist()):
            hashes[i:j].sort()
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        new[ends[:-1]] = True  # equal to the last of the line before, maybe
        edges = [0, *np.cumsum(new)[ends - 1].tolist()]
        hashes = hashes[new]
        found += [hashes[i:j] for i, j in zip(edges, edges[1:])]
    return found


def lines_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """content, key, text of the lines at places(content, key, row, line); docs: row, text."""
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("content", "key", "line")).alias("lines"))
    small = runtime.is_under(places, FEW)
    found = docs.select("row", "text").join(F.broadcast(wanted) if small else wanted, "row")
    # the lines are taken out before the rows are spread, so that no row carries a whole text
    taken = F.transform("lines", lambda at: F.struct(at["content"].alias("content"), at["key"].alias("key"), F.get(F.col("parts"), at["line"]).alias("text")))
    return found.select("lines", F.split("text", "\n", -1).alias("parts")).select(F.inline(taken))


def lines_in(docs: DataFrame) -> int:
    """About the number of lines, to deal them out: there is no need to look for them."""
    return docs.agg(F.sum(F.ceil(F.octet_length("text") / BYTES))).first()[0] or 0


def dropped(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """row, lines (the numbers of those that go) of the documents that lose a line; docs: row, doc_id, text."""
    made = runtime.written(gathered(entries(docs, parts_for(lines_in(docs), BANDS)), twice=False), "line-entries")
    found = made.where("band is not null").select("band", "a", "b")
    # a line that comes once has its only place among the first ones
    lines = made.where("content is not null and (n is null or n > 1)").select("content", "row", "line")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line")
    wanted = found.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("near", F.lit(True))
    # lines that come once and have no candidate are settled
    known = made.where("n is not null").join(wanted, "key", "left").where("near or n > 1")
    known = runtime.written(known.select("content", "key", order.alias("first"), "n", "near"), "line-keys")
    places = known.where("near").select("content", "key", F.col("first.row").alias("row"), F.col("first.line").alias("line"))
    # rows that repeat give a text several nodes, which near_groups() unites as they share a key
    texts = numbered(lines_of(docs, places), "line-texts")
    roots = near_groups(found, texts, shingle_ids, least, BLOCK)
    # the group of a line without links is named by its content, any other by its root
    group = texts.groupBy("content").agg(F.min("node").alias("node")).join(roots, "node", "left").select("content", F.concat(F.lit("node "), F.coalesce("root", "node").cast("string")).cast("binary").alias("group"))
    named = known.join(group, "content", "left").select("content", "first", "n", F.coalesce("group", "content").alias("group"))
    groups = named.groupBy("group").agg(F.min("first").alias("stays"), F.sum("n").alias("size")).where("size > 1")
    stays = F.col("stays.row").alias("stay_row"), F.col("stays.line").alias("stay_line")
    repeated = runtime.written(named.join(groups, "group").select("content", "n", F.col("first.row").alias("row"), F.col("first.line").alias("line"), *stays), "repeated-lines")
    place = "row", "line", "stay_row", "stay_line"
    places = lines.join(repeated.where("n > 1").select("content", "stay_row", "stay_line"), "content").select(*place).unionByName(repeated.where("n = 1").select(*place))
    goes = places.where((F.col("row") != F.col("stay_row")) | (F.col("line") != F.col("stay_line")))
    return goes.groupBy("row").agg(F.collect_set("line").alias("lines"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc (the row of docs), text (what stays of it), lines (the sorted numbers of the lines that went), one row per row of docs."""
    rows = with_row(docs, id_col, text_col)
    goes = dropped(rows.select("row", "doc_id", "text"), least)
    text = F.col(f"doc.`{text_col}`")  # the texts are shuffled once
    stay = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("lines", i)), "\n")
    joined = rows.select("row", "doc").join(goes.hint("shuffle_hash"), "row", "left")  # so that no text is sorted
    return joined.select("doc", F.when(F.col("lines").isNull(), text).otherwise(stay).alias("text"), F.sort_array(F.coalesce("lines", F.array().cast("array<int>"))).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs with its own columns, the texts without the lines that go."""
    made = deduplicated(docs, id_col, text_col, least)
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0), text: one row per document."""
    made = deduplicated(docs)
    text = F.col("doc.text")
    n = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return made.select("doc.doc_id", n.cast("long").alias("n_lines"), F.size("lines").cast("long").alias("n_dropped"), F.col("lines").alias("dropped"), "text")
