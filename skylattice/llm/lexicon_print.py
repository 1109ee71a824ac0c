"""I-Match fingerprints with several randomised lexicons, in DataFrame functions only.

The lexicon holds the terms (lower-cased runs of letters and digits) whose inverse document frequency, counted over all distinct
texts, lies in a chosen band: terms in at least RARE of the texts (and in two at least) and at most COMMON of them. So a group of
copies, however large, counts as one text. A document's
distinct lexicon terms are sorted and hashed once for each of several randomised sub-lexicons. A sub-lexicon keeps each term with
a chance of 1/share; sparse ones survive edits of long texts, dense ones serve short texts. A fingerprint is the list of
sub-lexicon numbers with their hashes; its likeness to another is the share of the sub-lexicons used by either whose hashes agree,
taken at the sparsest share at which the two use at least ENOUGH sub-lexicons. A text that uses fewer even of the densest ones gets as many more over all its terms,
whatever their frequency; two such texts are compared at these, in the same way (else at the densest).

Equal texts have equal fingerprints. A text without a term gets one hash of the text, marked as such: likeness 1 to its equal, 0 to
others.

Terms are hashed into SLOTS slots and document frequencies are counted by slot, so the lexicon is a bit map of fixed size at any
corpus size; it is a constant of the plan, and membership is tested where a text is read. Terms that share a slot are in the
lexicon or out of it together.

The next document in order of doc_id is found without sorting everything in one task: quantiles of doc_id (real ids), as many as
the rows ask for, split the order into ranges, and the first row of each range is also sent to the range before it.

Defined results: null text counts as empty. Rows without an id come last, in order of a
hash of their text, which is split into ranges of its own. Rows that repeat an id follow one another in order of
text. A single row is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skylattice import runtime

#: Slots of the lexicon, a power of two.
SLOTS = 1 << 20
#: The band: least and largest share of the documents.
RARE, COMMON = 0.0005, 0.05
#: One term in so many goes to a sub-lexicon of each kind; there are GROUPS sub-lexicons of each kind.
SHARES = (64, 512, 4096)
GROUPS = 64
ENOUGH = 12
#: Kinds over the lexicon, from the densest on; those over all terms follow, at the same shares.
KINDS = len(SHARES)
#: Bits of a term beside the number of its sub-lexicon.
BITS = 54
#: Lexicon terms of a text that are looked at to say whether it uses ENOUGH of the densest sub-lexicons.
LOOK = 200
#: Ranges of the order: at least and at most, and rows of one between these.
RANGES, MOST_RANGES, ROWS_OF_A_RANGE = 256, 8192, 10_000


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    return F.array_distinct(F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, rare: float = RARE, common: float = COMMON) -> list[int]:
    """The bit map of the slots in the band, as 64-bit numbers; docs has text. Equal texts count once: their slots meet by a hash of the text, once from each task."""
    slots = F.array_distinct(F.transform(terms(F.col("text")), lambda t: t.bitwiseAND(F.lit(SLOTS - 1)).cast("int")))
    total = docs.select(F.xxhash64("text")).distinct().count()
    texts = docs.select(F.xxhash64("text").alias("text"), slots.alias("slots")).groupBy("text").agg(F.first("slots").alias("slots"))
    counts = texts.select(F.explode("slots").alias("slot")).groupBy("slot").count()
    word = F.shiftright("slot", 6)
    band = counts.where(F.col("count").between(max(2, int(rare * total)), max(2, int(common * total))))
    bits = band.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    found = {r["word"]: r["bits"] for r in bits.collect()}
    return [found.get(i, 0) for i in range(SLOTS // 64)]


def ranged(docs: DataFrame) -> DataFrame:
    """docs with `part`, the range of (no_id, key), and `guest`: a row whose key starts a range comes twice, once as the guest of the range before (the first of all: of the last)."""
    counts = {r["no_id"]: r["count"] for r in docs.groupBy("no_id").count().collect()}
    sides, first = [], 0
    for no_id in sorted(counts):
        ranges = min(MOST_RANGES, max(RANGES, counts[no_id] // ROWS_OF_A_RANGE))
        edges = docs.where(F.col("no_id") == no_id).agg(F.min("key").alias("least"), F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("at")).first()
        starts = sorted({edges["least"], *edges["at"]})
        held = F.from_json(F.lit(str(starts)), "array<bigint>")
        jumps = F.array(*[F.lit(1 << s) for s in range(len(starts).bit_length() - 1, -1, -1)])
        # a binary search for the last start that is at most the key, from 0
        place = F.aggregate(jumps, F.lit(0), lambda at, j: F.when((at + j < len(starts)) & (F.get(held, at + j) <= F.col("key")), at + j).otherwise(at))  # noqa: B023
        sides.append((no_id, first, held, place))
        first += len(starts)
    if not sides:
        return docs.withColumn("part", F.lit(0)).withColumn("guest", F.lit(False))
    of = lambda values: F.coalesce(*[F.when(F.col("no_id") == no_id, v) for (no_id, *_), v in zip(sides, values)])
    home = F.struct(F.col("at").alias("part"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("at") - 1, F.lit(first)).alias("part"), F.lit(True).alias("guest"))
    starts_it = of([F.get(held, F.col("at") - begin) == F.col("key") for _, begin, held, _ in sides])
    placed = docs.withColumn("at", of([place + begin for _, begin, _, place in sides]))
    return placed.withColumn("copy", F.explode(F.when(starts_it, F.array(home, before)).otherwise(F.array(home)))).select(*docs.columns, "copy.part", "copy.guest")


def slot(kind: int, term: Column) -> Column:
    """The sub-lexicon of a kind that holds the term, or one beyond GROUPS."""
    return F.pmod(F.shiftrightunsigned(term, 22 + 13 * kind), F.lit(SHARES[kind]))


def members(kept: str, k: int) -> Column:
    """The terms that a sub-lexicon of a kind holds; those of kind 0 hold all."""
    return F.filter(kept, lambda t: slot(k, t) < GROUPS) if k else F.col(kept)


def slots_of(column: str | Column, k: int) -> Column:
    return F.transform(column, lambda t: slot(k, t))


def packed(column: str, k: int) -> Column:
    """Each term as (sub-lexicon number << BITS | BITS bits of the term)."""
    return F.transform(column, lambda t: F.shiftleft(slot(k % KINDS, t) + k * GROUPS, BITS).bitwiseOR(t.bitwiseAND(F.lit((1 << BITS) - 1))))


def printed(rows: DataFrame, text: str, out: str, bits: Column) -> DataFrame:
    """rows and `out`, the print of a text column: sorted (sub-lexicon number << 40 | 40 bits of the hash of its sorted terms), or one negative number where there is no term.

    A kind of which the text itself uses ENOUGH sub-lexicons is never compared at a denser share, so the denser kinds are left out.
    Each step is a column that the next one uses more than once, so nothing is computed twice.
    """
    low = lambda t, n: t.bitwiseAND(F.lit(n - 1))
    held = lambda t: F.getbit(F.get(bits, F.shiftright(low(t, SLOTS), 6).cast("int")), low(t, 64).cast("int")) == 1
    none = F.array().cast("array<bigint>")
    made = rows.withColumn("_every", terms(F.col(text))).withColumn("_kept", F.filter("_every", held))
    # LOOK terms may use fewer sub-lexicons than all: then the kinds over all terms are there without need, never missing
    used = F.size(F.array_distinct(slots_of(F.slice("_kept", 1, LOOK), 0)))
    made = made.withColumn("_wide", F.when(used >= ENOUGH, none).otherwise(F.col("_every")))
    parts = []
    for first, held_terms in ((0, "_kept"), (KINDS, "_wide")):
        made = made.withColumns({f"_m{first + k}": members(held_terms, k) for k in range(KINDS)})
        made = made.withColumns({f"_u{first + k}": F.size(F.array_distinct(slots_of(f"_m{first + k}", k))) for k in range(1, KINDS)})
        for k in range(KINDS):
            part = packed(f"_m{first + k}", first + k)
            for j in range(k + 1, KINDS):
                part = F.when(F.col(f"_u{first + j}") >= ENOUGH, none).otherwise(part)
            parts.append(part)
    made = made.withColumn("_all", F.sort_array(F.concat(*parts)))
    number = lambda x: F.shiftright(x, BITS)
    at = lambda i: F.get("_all", i)
    first = F.filter(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: (i == 0) | (number(at(i)) != number(at(i - 1))))
    made = made.withColumn("_starts", F.when(F.size("_all") > 0, first).otherwise(F.array().cast("array<int>")))
    hashed = lambda a, j: F.xxhash64(F.slice(F.col("_all"), a + 1, F.coalesce(F.get("_starts", j + 1), F.size("_all")) - a))
    some = F.transform("_starts", lambda a, j: F.shiftleft(number(at(a)), 40).bitwiseOR(hashed(a, j).bitwiseAND(F.lit((1 << 40) - 1))))
    found = F.when(F.size("_starts") > 0, some).otherwise(F.array(-F.shiftrightunsigned(F.xxhash64(F.col(text)), 2) - 1))
    return made.select(*rows.columns, found.alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Of two prints, 0 to 1."""
    of = lambda x, k: F.filter(x, lambda e: (e >= 0) & (F.shiftright(e, 46) == k))
    out = None
    for k in (*range(KINDS, 2 * KINDS), *range(KINDS)):
        one, two = of(a, k), of(b, k)
        numbers = lambda x: F.transform(x, lambda e: F.shiftright(e, 40))
        used, same = F.size(F.array_union(numbers(one), numbers(two))), F.size(F.array_intersect(one, two))
        share = F.when(used > 0, same / used).otherwise(F.lit(0.0))
        out = share if out is None else F.when(used >= ENOUGH, share).otherwise(out)
    return F.when(a == b, F.lit(1.0)).otherwise(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"no_id": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.xxhash64("text"))})
    bits = F.from_json(F.lit(str(lexicon(rows))), "array<bigint>")
    spread = ranged(rows)
    # the guest of a range comes after its residents; that of the last range is the very first document
    order = W.partitionBy("part").orderBy("guest", "no_id", "key", "text")
    n = F.length("text")
    edit = F.expr("concat(left(text, length(text) - int(floor(length(text) / 4))), left(next_text, int(floor(length(text) / 4))))")
    made = spread.withColumn("next_text", F.coalesce(F.lead("text").over(order), "text")).withColumn("edited", edit)
    made = made.select("part", "guest", "no_id", "key", "text", "edited", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    made = printed(printed(made, "text", "own", bits), "edited", "other", bits).drop("edited")
    made = made.withColumn("next", F.coalesce(F.lead("own").over(order), "own")).where(~F.col("guest"))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.lower(F.hex(e))), " ")
    return made.select("doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("other").alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
