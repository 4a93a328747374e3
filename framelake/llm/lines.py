"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are what ``\\n`` separates, without spaces around them; blank ones take no part and always stay. Two lines of
``MIN_CHARS`` characters or more link when at most ``edits`` insertions, deletions or substitutions of characters turn
one into the other; shorter ones link with none. A line of any length goes when an equal or linked line occurs earlier,
by doc_id, text (as hashed) and line number.

A line is split into edits+1 segments; one of them occurs unchanged, a few characters off at most, in every linked line.
Segments have one width for all lengths of a class of three times ``STEP`` characters, so that they are indexed by (width,
segment number, characters), the first and the last at no offset; lines at the border of a class probe the class below
too. Keys that one line alone has are dropped by an aggregation that combines before its shuffle, whatever the number of
copies. Only lines that meet have letters counted. Where more than ``HOT`` of them share a key, they meet by the key and the
counts of one group of letters in turn. Pairs about equal in all letters are verified, by edit distance over a band of bits.

Nulls and empty texts have no lines. Rows that repeat a doc_id with its text count as one document; rows that repeat it
with other texts are documents of their own. A null doc_id comes before all others. Lines of any length are compared whole.
An empty table gives none; other columns are kept by the stage and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import table, written

MIN_CHARS, EDITS, STEP = 50, 2, 8
#: Lines of one key that are compared at once.
HOT = 32
#: Characters counted in each line, to pass over pairs whose counts differ too much.
COUNTED = "etnirsaoldhucmfg"
#: Bytes of rows that may be broadcast in one join, as counted; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
PLACE = "doc_id", "t", "no"


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows of about ``row_bytes`` are few; counted first."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def line_rows(docs: DataFrame, min_chars: int, text: bool = True) -> DataFrame:
    """doc_id, t (hash of its text), no (from 0), size, two hashes a and b, and the line, of each line that takes part.

    All of a line's values come out of one generator: as plain columns, the optimizer would write the expressions of
    line and size into each of the many keys made from them.
    """

    def of(line: Column, no: Column) -> Column:
        values = [no.alias("no"), F.length(line).alias("size"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b")]
        return F.struct(*values, *([line.alias("line")] if text else []))

    lines = F.transform(F.split("text", "\n"), lambda line, no: F.struct(F.trim(line).alias("line"), no.alias("no")))
    long = F.filter(lines, lambda x: F.length(x.line) >= min_chars)
    return docs.select("doc_id", F.xxhash64("text").alias("t"), F.inline(F.transform(long, lambda x: of(x.line, x.no))))


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """a, size, key and own of each segment of a line (own) and of each place where it may hold one of another line.

    Of width w, segment i starts at i*w and is edits//2 shorter, the last one ends the line. An unchanged segment lies up
    to min(i, edits-i) characters before, or i after, its own place. The former needs no probe between lines of one class:
    seen from the other line it lies after, and the spare characters are part of what is unchanged.
    """
    parts, slack = edits + 1, edits // 2
    rows = lines.withColumn("_w", F.expr(f"cast({STEP} * (size div {parts * STEP}) as int)")).withColumn("_low", F.expr(f"cast({STEP} * ((size - {edits}) div {parts * STEP}) as int)"))

    def part(w: str, i: int, off: int, own: bool) -> str:
        n = w if i in (0, edits) else f"greatest({w} - {slack}, 0)"
        at = f"size - {w} + 1" if i == edits else f"{w} * {i} + {off + 1}"
        return f"named_struct('key', xxhash64({w}, {i}, substring(line, {at}, {n})), 'own', {own})"

    own = [part("_w", i, 0, True) for i in range(parts)]
    after = [part("_w", i, off, False) for i in range(1, edits) for off in range(1, i + 1)]
    below = [part("_low", i, off, False) for i in range(parts) for off in (range(-min(i, edits - i), i + 1) if i < edits else [0])]
    every = f"array({', '.join(own + after)})"
    return rows.select("a", "size", F.expr(f"inline(if(_low < _w, concat({every}, array({', '.join(below)})), {every}))"))


def _counts(line: Column) -> Column:
    """How often each of COUNTED occurs in the line, modulo 16, in four bits of a long each."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(COUNTED):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16
        out = out.bitwiseOR(F.shiftleft(n.cast("long"), 4 * i))
    return out


def _apart(one: str, other: str) -> str:
    """A lower bound of twice the edit distance, from two packed counts."""
    lanes = [f"abs((shiftright({one}, {4 * i}) & 15) - (shiftright({other}, {4 * i}) & 15))" for i in range(len(COUNTED))]
    return " + ".join(f"least({x}, 16 - {x})" for x in lanes)


def _shared(one: str, other: str, most: str) -> str:
    """Length of the common prefix of two strings, up to ``most``, by halving steps."""
    steps = ", ".join(str(1 << k) for k in range(24, -1, -1))
    same = f"substring({one}, at + 1, step) = substring({other}, at + 1, step)"
    return f"aggregate(array({steps}), 0, (at, step) -> if(at + step <= {most} and {same}, at + step, at))"


def with_distance(pairs: DataFrame, one: str, other: str, edits: int) -> DataFrame:
    """``pairs`` and the edit distance of two columns; above ``edits`` it is only above ``edits``.

    What both have in common at the start and at the end is taken off first. The rests then differ at both ends, so
    that at most edits-2 edits lie between: of edits-1 segments there, one must occur in the other rest too, shifted by
    ``edits`` at most, or the pair is passed over. Bit t of each word then stands for row
    j-edits+t of column j: a band of 2*edits+1 cells that moves down the diagonal. vp and vn hold where the column
    grows or falls by one, d0 where a diagonal step is free. The last cell lies on one diagonal, so the distance is
    that diagonal's start plus its steps that aren't free.
    """
    ones, above = (1 << 2 * edits + 1) - 1, (1 << edits) - 1
    most = f"least(length({one}), length({other}))"
    inner, parts = f"(_m - {2 * edits})", max(1, edits - 1)
    spans = [(f"({edits} + {inner} * {i} div {parts})", f"({inner} * {i + 1} div {parts} - {inner} * {i} div {parts})") for i in range(parts)]
    again = " or ".join(f"exists(sequence(-{edits}, {edits}), d -> substring(_b, cast({at} + d + 1 as int), cast({n} as int)) = substring(_a, cast({at} + 1 as int), cast({n} as int)))" for at, n in spans)
    # each step a table: else the optimizer repeats a step's expressions wherever the next one uses them
    cut = written(pairs.withColumn("_head", F.expr(_shared(one, other, most))))
    cut = cut.withColumn("_a", F.expr(f"reverse(substring({one}, _head + 1))")).withColumn("_b", F.expr(f"reverse(substring({other}, _head + 1))"))
    cut = written(cut.drop("_head"))
    cut = written(cut.withColumn("_tail", F.expr(_shared("_a", "_b", "least(length(_a), length(_b))"))))
    cut = cut.withColumn("_a", F.expr("substring(_a, _tail + 1)")).withColumn("_b", F.expr("substring(_b, _tail + 1)")).drop("_tail")
    cut = written(cut.withColumn("_m", F.length("_a")).withColumn("_n", F.length("_b")).withColumn("_rows", F.expr(f"concat(array_repeat('', {edits}), split(_a, ''))")))
    matches = " | ".join(f"if(try_element_at(_rows, j + {t + 1}) = c, {1 << t}L, 0L)" for t in range(2 * edits + 1))
    distance = f"""
        aggregate(
            transform(slice(split(_b, ''), 1, _n), (c, j) -> {matches}),
            named_struct('vp', {ones ^ above}L, 'vn', {above}L, 'j', 0, 'cost', abs(_m - _n)),
            (s, pm) -> transform(
                transform(array(((((pm & s.vp) + s.vp) ^ s.vp) | pm | s.vn) & {ones}L), d0 ->
                    named_struct('d0', d0, 'half', shiftright(d0, 1), 'hp', (s.vn | ~(d0 | s.vp)) & {ones}L, 'hn', d0 & s.vp)),
                bits -> named_struct(
                    'vp', (bits.hn | ~(bits.half | bits.hp)) & {ones}L,
                    'vn', bits.half & bits.hp,
                    'j', s.j + 1,
                    'cost', s.cost + if(s.j >= _n - _m AND (shiftright(bits.d0, _m - _n + {edits}) & 1L) = 0L, 1, 0)))[0],
            s -> s.cost)
    """
    out = cut.withColumn("distance", F.expr(f"case when abs(_m - _n) > {edits} then abs(_m - _n) when _m = 0 or _n = 0 then _m + _n when _m > {2 * edits} and not ({again}) then {edits + 1} else {distance} end"))
    return written(out.drop("_a", "_b", "_m", "_n", "_rows"))


def met(rows: DataFrame) -> DataFrame:
    """Keys that two different lines have, one of them as its own."""
    both = rows.groupBy("key").agg(F.min("a").alias("x"), F.max("a").alias("y"), F.max("own").alias("own"))
    return written(both.where("x <> y and own").select("key"))


def by_letters(members: DataFrame, edits: int) -> DataFrame:
    """Rows of ``members`` with a key for each group of letters that it counts.

    Counts of linked lines differ by 2*edits in all, so of 2*edits+1 groups one has no difference.
    """
    groups = 2 * edits + 1
    masks = [sum(15 << 4 * i for i in range(g, len(COUNTED), groups)) for g in range(groups)]
    keys = F.array(*[F.xxhash64("key", F.lit(g), F.col("counts").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for g, m in enumerate(masks)])
    return members.withColumn("key", F.explode(keys))


def candidates(lines: DataFrame, texts_of: Callable[[DataFrame], DataFrame], edits: int) -> tuple[DataFrame, DataFrame]:
    """(x, y: hashes of lines that share a segment and about the same letters, once; the texts of all that met)."""
    rows = segment_keys(lines, edits)
    members = written(rows.join(small(met(rows)), "key").groupBy("key", "a", "size").agg(F.max("own").alias("own")))
    texts = texts_of(members.select("a").distinct())
    members = written(members.join(texts.select("a", _counts(F.col("line")).alias("counts")), "a"))
    hot = small(written(members.groupBy("key").count().where(f"count > {HOT}").select("key")))
    members = members.join(hot, "key", "left_anti").unionByName(by_letters(members.join(hot, "key"), edits).select(members.columns))
    close = f"x.a < y.a and (x.own or y.own) and abs(x.size - y.size) <= {edits} and {_apart('x.counts', 'y.counts')} <= {2 * edits}"
    return written(members.alias("x").join(members.alias("y"), "key").where(close).select(F.col("x.a").alias("x"), F.col("y.a").alias("y")).distinct()), texts


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places: doc_id, t, no, a, b of each line but blank ones; firsts: a, b, first place and copies of each different
    line; links: a, b, a2, b2 of each two different lines that link, once)."""
    lines = line_rows(docs, min_chars)
    places = written(line_rows(docs, 1, False).drop("size"))
    firsts = written(places.groupBy("a", "b").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("copies")))

    def texts_of(ids: DataFrame) -> DataFrame:
        """a, b and line of the first copies of lines."""
        first = written(firsts.join(small(written(ids), 16), "a").select("a", "first.doc_id", "first.no"))
        same = F.expr("l.a = f.a and l.no = f.no and l.doc_id <=> f.doc_id")
        return written(lines.alias("l").join(small(first, 32).alias("f"), same).select("l.a", "l.b", "l.line").distinct())

    pairs, texts = candidates(lines, texts_of, edits)
    both = pairs.join(texts.select(F.col("a").alias("x"), "b", "line"), "x").join(texts.select(F.col("a").alias("y"), F.col("b").alias("b2"), F.col("line").alias("line2")), "y")
    near = with_distance(both, "line", "line2", edits).where(F.col("distance") <= edits)
    return places, firsts, written(near.select(F.col("x").alias("a"), "b", F.col("y").alias("a2"), "b2"))


def dropped_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t, no, of each line that goes, the place (keeper) of the earliest line that it equals or links with, and
    how many other lines (links) it links with."""
    places, firsts, links = line_links(docs, edits, min_chars)
    first = firsts.select("a", "b", "first", "copies")
    there = links.unionByName(links.select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2")))
    near = there.join(first.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("first").alias("other")), ["a2", "b2"])
    near = near.groupBy("a", "b").agg(F.min("other").alias("other"), F.count("*").alias("links"))
    of_note = first.join(near, ["a", "b"], "left").where("copies > 1 or other is not null")
    of_note = written(of_note.select("a", "b", F.least("first", "other").alias("keeper"), F.coalesce("links", F.lit(0)).alias("links")))
    out = places.join(small(of_note, 96), ["a", "b"])
    return out.where(~F.struct(*PLACE).eqNullSafe(F.col("keeper"))).select(*PLACE, "keeper", "links")


def by_document(dropped: DataFrame) -> DataFrame:
    """doc_id, t and, of its lines that go: numbers, documents of the lines that stay, and links."""
    of = dropped.groupBy("doc_id", "t").agg(
        F.array_sort(F.collect_set("no")).alias("dropped_lines"),
        F.array_sort(F.collect_set("keeper.doc_id")).alias("kept_in"),
        F.sum("links").alias("n_links"),
    )
    return written(of)


def with_dropped(docs: DataFrame, by: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct d, with what ``by_document`` says of it as the struct o."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"), F.xxhash64("text").alias("t"))
    size = by.agg(F.coalesce(F.sum(64 + 4 * F.size("dropped_lines") + 8 * F.size("kept_in")), F.lit(0))).first()[0]
    o = by.select(F.struct("*").alias("o"))
    return rows.join(F.broadcast(o) if size <= BROADCAST_BYTES else o, F.expr("d.doc_id <=> o.doc_id and t = o.t"), "left")


def deduplicated(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, dropped_lines, kept_in, n_links and kept_chars."""
    by = by_document(dropped_lines(docs, edits, min_chars))
    found = with_dropped(docs.select("doc_id", "text"), by)
    lines = F.coalesce(F.split("d.text", "\n"), F.array().cast("array<string>"))
    drop = F.coalesce("o.dropped_lines", F.array().cast("array<int>"))
    stays = F.filter(lines, lambda line, no: ~F.array_contains(drop, no))
    return found.select(
        "d.doc_id",
        F.size(lines).alias("n_lines"),
        F.size(drop).alias("n_dropped"),
        drop.alias("dropped_lines"),
        F.coalesce("o.kept_in", F.array().cast("array<bigint>")).alias("kept_in"),
        F.coalesce("o.n_links", F.lit(0)).alias("n_links"),
        F.length(F.array_join(stays, "\n")).alias("kept_chars"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that go; n_chars follows. A document that loses lines and keeps only blank ones goes with them."""
    found = with_dropped(docs, by_document(dropped_lines(docs)))
    left = F.array_join(F.expr("filter(split(d.text, '\n'), (x, i) -> not array_contains(o.dropped_lines, i))"), "\n")
    found = found.withColumn("left", F.when(F.col("o.t").isNull(), F.col("d.text")).otherwise(left))
    found = found.where(F.col("o.t").isNull() | (F.trim("left") != ""))
    new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}
    return found.select(*(new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns))
