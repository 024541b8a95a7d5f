"""Line dedup: lines spread over many sites are boilerplate, by HyperLogLog sketches of the sites of each line.

A line is a ``\\n``-separated piece of a text, trimmed of spaces. Its spread is
the number of distinct sites that have it. Occurrences are counted by line and
site before anything else, so however common a line is, later steps have a row
of it for each site. A plain count leaves the lines that occur often enough and
on several sites; their sketches of sites merge in an aggregation, and where the
estimate lies near the threshold, an exact distinct count decides. Lines of few
words are found on many sites by chance, so they need more of them.

A copy on many sites consists of spread lines without being boilerplate, and
document dedup has to treat it. So a document keeps its lines if they hold more
than half of its words and it is shown to be a copy as a whole: its text stands
on as many sites as make a line spread, or

* its spread lines stand together elsewhere: another row has the same text, or
  at least half of its pairs of successive spread lines are found, adjacent in
  that order, in another such text;
* and so does the rest: the words of its other lines are a ninth at most (two
  texts that share the others reach a similarity of 0.8), or at least half of
  the runs of three words in these lines are found in another such text.

Pages of one template share their menu, but not what is their own, and lose the
menu.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herald.llm._common import materialize, n_words, text_key, text_of, words

#: Relative distance from the threshold within which an estimate is not trusted: above five standard errors of a sketch of 2**12 registers.
NEAR = 0.1
#: Words of which texts may differ, to those they share, if they reach a similarity of 0.8: one in this many of all.
NINTH = 9
#: Bits of a table of text keys (1 MB whatever the input), and of one of its rows.
BITS, ROW = 1 << 23, 1 << 15
#: Words of a run that two edited lines share.
RUN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(text: Column) -> Column:
    return F.transform(_lines(text), lambda x: F.trim(x))  # a bare F.trim would take the index as what to trim


def _sifted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (__t1) with ``__maybe``: false only if no row of ``keys`` (t1) has that key.

    The keys' bits are a table of fixed size, which is broadcast; what it rules
    out need not be shuffled to be joined. With more keys than bits it rules
    out nothing, and all rows are joined.
    """
    def place(c: str) -> tuple[Column, Column]:
        at = F.pmod(F.col(c), F.lit(BITS))
        return F.floor(at / ROW).cast("int"), (at % ROW).cast("int")

    row, at = place("t1")
    table = keys.select(row.alias("__row"), at.cast("long").alias("at")).groupBy("__row").agg(F.bitmap_construct_agg("at").alias("__bits"))
    row, at = place("__t1")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, at % 8).bitwiseAND(1) == 1
    joined = rows.join(F.broadcast(table), row == F.col("__row"), "left")
    return joined.withColumn("__maybe", F.coalesce(is_set, F.lit(False))).drop("__row", "__bits")


def spread_lines(
    docs: DataFrame, site: str = "source", sites: int = 5, min_words: int = 3, short_sites: int = 25, lg_k: int = 12
) -> DataFrame:
    """(k1, k2, words) of the lines on at least ``sites`` distinct sites; of fewer than ``min_words`` words, ``short_sites``.

    A null site is not counted. Blank and null texts have no lines, and an
    empty table gives none.
    """
    line = docs.select(F.col(site).cast("string").alias("site"), F.explode(_trimmed(text_of("text"))).alias("line"))
    line = line.filter("site is not null and line != ''")
    rows = line.select(*text_key(F.col("line")), F.xxhash64("site").alias("site"), n_words(F.col("line")).alias("words"))
    pairs = materialize(rows.groupBy("k1", "k2", "site").agg(F.count("*").alias("n"), F.max("words").alias("words")))
    need = F.when(F.col("words") >= min_words, F.lit(sites)).otherwise(F.lit(short_sites))
    seen = pairs.groupBy("k1", "k2").agg(
        F.sum("n").alias("n"), F.max("words").alias("words"), (F.min("site") != F.max("site")).alias("several")).withColumn("need", need)
    # a line of too few occurrences, or of one site, needs no sketch
    able = materialize(seen.filter((F.col("n") >= F.col("need")) & (F.col("several") | (F.col("need") < 2))).select("k1", "k2", "words", "need"))
    of = pairs.select("k1", "k2", "site").join(able, ["k1", "k2"])
    sketched = of.groupBy("k1", "k2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"), *[F.max(c).alias(c) for c in ("words", "need")])
    return _decide(of, materialize(sketched))


def _decide(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    sure = sketched.filter(F.col("estimate") > F.col("need") * (1 + NEAR)).select("k1", "k2", "words")
    near = F.col("estimate").between(F.col("need") * (1 - NEAR) - 1, F.col("need") * (1 + NEAR))
    exact = pairs.join(sketched.filter(near).select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(
        F.count_distinct("site").alias("s"), *[F.max(c).alias(c) for c in ("words", "need")])
    return sure.unionByName(exact.filter("s >= need").select("k1", "k2", "words"))


def mark_lines(
    docs: DataFrame, site: str = "source", sites: int = 5, min_words: int = 3, short_sites: int = 25, most: float = 0.5
) -> DataFrame:
    """For each distinct text with boilerplate lines: its key (t1, t2), the positions ``drop`` of these from 0, and ``words`` in them.

    Texts that are shown to be copies are left out: of their words spread
    lines hold more than ``most``, and both these and the rest are shared.
    """
    spread = materialize(spread_lines(docs, site, sites, min_words, short_sites))
    texts = docs.select(text_of("text").alias("text"), F.xxhash64(F.col(site).cast("string")).alias("site"), F.isnull(site).alias("nowhere"))
    rows = texts.select(
        *[c.alias(a) for c, a in zip(text_key(F.col("text")), ("t1", "t2"))], n_words(F.col("text")).alias("all_words"),
        F.posexplode(_trimmed(F.col("text"))).alias("at", "line")
    )
    rows = rows.filter("line != ''").select("t1", "t2", "all_words", "at", *text_key(F.col("line")))
    hit = rows.join(spread, ["k1", "k2"]).groupBy("t1", "t2", "at").agg(
        *[F.max(c).alias(c) for c in ("k1", "words", "all_words")], F.count("*").alias("twins"))
    of = hit.groupBy("t1", "t2").agg(
        F.sort_array(F.collect_list(F.struct("at", "k1"))).alias("found"), F.sum("words").alias("words"),
        *[F.max(c).alias(c) for c in ("all_words", "twins")]
    )
    of = materialize(of)
    return of.join(
        _copies(texts, materialize(of.filter(F.col("words") > most * F.col("all_words"))), sites), ["t1", "t2"], "left_anti"
    ).select("t1", "t2", F.col("found.at").alias("drop"), "words")


def _copies(texts: DataFrame, mostly: DataFrame, sites: int) -> DataFrame:
    """Keys of those texts, of spread lines mostly, that others repeat as a whole."""
    after = F.zip_with(
        "found", F.slice("found", F.lit(2), F.size("found")), lambda a, b: F.struct(a["k1"].alias("first"), b["k1"].alias("then"))
    )
    pair = mostly.select("t1", "t2", F.explode(F.array_distinct(F.filter(after, lambda p: p["then"].isNotNull()))).alias("x"))
    together = mostly.filter("twins > 1").select("t1", "t2").unionByName(_shared(pair))
    t1, t2 = text_key(F.col("text"))
    edited = mostly.filter(NINTH * F.col("words") < (NINTH - 1) * F.col("all_words")).select("t1", "t2", F.lit(True).alias("edited"))
    known = mostly.select("t1", "t2", F.col("found.at").alias("at")).join(edited, ["t1", "t2"], "left")
    known = known.select(F.col("t1").alias("u1"), F.col("t2").alias("u2"), "at", F.coalesce("edited", F.lit(False)).alias("edited"))
    able = _sifted(texts.withColumns({"__t1": t1, "__t2": t2}), mostly).filter("__maybe").withColumnsRenamed({"__t1": "t1", "__t2": "t2"})
    there = able.join(known, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    line = F.transform(_lines(F.col("text")), lambda x, i: F.struct(
        _runs(x).alias("runs"), (F.col("edited") & ~F.array_contains(F.col("at"), i)).alias("own")))
    own, spread = (F.flatten(F.transform(F.filter("line", f), lambda x: x["runs"])) for f in (lambda x: x["own"], lambda x: ~x["own"]))
    there = there.select("t1", "t2", "site", "nowhere", line.alias("line"))
    there = materialize(there.select("t1", "t2", "site", "nowhere", F.array_distinct(own).alias("own"), F.array_distinct(spread).alias("spread")))
    run = there.select("t1", "t2", F.explode(F.concat(
        F.transform("own", lambda x: F.struct(x.alias("x"), F.lit(True).alias("own"))),
        F.transform("spread", lambda x: F.struct(x.alias("x"), F.lit(False).alias("own"))))).alias("r"))
    run = run.groupBy("t1", "t2", F.col("r.x").alias("x")).agg(F.max("r.own").alias("own"))
    rest = mostly.filter(NINTH * F.col("words") >= (NINTH - 1) * F.col("all_words")).select("t1", "t2").unionByName(_shared(run, F.col("own")))
    on = there.filter("not nowhere").select("t1", "t2", "site").distinct()
    everywhere = on.groupBy("t1", "t2").agg(F.count("*").alias("s")).filter(F.col("s") >= sites).select("t1", "t2")
    return together.join(rest, ["t1", "t2"], "left_semi").unionByName(everywhere).distinct()


def _runs(line: Column) -> Column:
    """Hashes of the runs of words of a line."""
    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= RUN, F.sequence(F.lit(1), F.size(w) - RUN + 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, RUN)))

    return F.get(F.transform(F.array(words(line)), of), F.lit(0))


def _shared(rows: DataFrame, counted: Column | None = None) -> DataFrame:
    """Keys of those texts of whose parts ``x``, or those that are counted, at least half are found in another text too.

    A text has a row for each part.
    """
    shared = rows.groupBy("x").agg((F.count("*") > 1).cast("long").alias("shared"))
    asked = rows if counted is None else rows.filter(counted)
    return asked.join(shared, "x").groupBy("t1", "t2").agg(F.avg("shared").alias("share")).filter("share >= 0.5").select("t1", "t2")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, site, others) with boilerplate lines taken out of ``text``; ``n_chars`` follows if there is one.

    ``options`` are those of :func:`mark_lines`. All rows stay. Texts without
    such lines are untouched, null ones too; what is left of others are their
    lines with the breaks between them. Equal texts are treated alike, and
    repeated rows stay repeated. Columns of any other name are kept as they
    are. An empty table gives an empty result.
    """
    marked = materialize(mark_lines(docs, **options).select("t1", "t2", "drop"))
    t1, t2 = text_key(text_of(docs["text"]))
    sifted = _sifted(docs.withColumns({"__t1": t1, "__t2": t2}), marked)
    marks = marked.select(F.col("t1").alias("__k1"), F.col("t2").alias("__k2"), F.col("drop").alias("__drop"))
    joined = sifted.filter("__maybe").join(marks, (F.col("__t1") == F.col("__k1")) & (F.col("__t2") == F.col("__k2")), "left")
    left = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(F.col("__drop"), i)), "\n")
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(left)
    out = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    # texts that cannot be marked go past the join; the length of each text is its own either way
    same = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    cut, whole = ([own[c].alias(c) if c in own else F.col(c) for c in docs.columns] for own in (out, same))
    return joined.select(*cut).unionByName(sifted.filter("not __maybe").select(*whole))


def report(docs: DataFrame, site: str = "source", **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, n_chars, text_md5) of :func:`dedup_lines`, a row for each row of ``docs``.

    Null texts count as empty; lines are those that are not blank. An empty
    table gives an empty result.
    """
    count = F.size(F.filter(_trimmed(text_of("text")), lambda x: x != F.lit(""))).cast("long")
    after = dedup_lines(docs.select("doc_id", site, "text", count.alias("n_lines")), site=site, **options)
    return after.select(
        "doc_id", "n_lines", (F.col("n_lines") - count).alias("n_dropped"), F.length(text_of("text")).cast("long").alias("n_chars"),
        F.md5(text_of("text")).alias("text_md5")
    )


SQL = r"""
WITH x AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS at FROM x),
t AS (SELECT *, trim(raw, ' ') AS line FROM l),
s AS (
  SELECT line FROM t WHERE line != '' GROUP BY line
  HAVING count(DISTINCT source) >= CASE WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3 THEN 5 ELSE 25 END),
m AS (
  SELECT t.doc_id, t.text, t.at, t.raw, t.line, s.line IS NOT NULL AS hit,
         len(regexp_extract_all(t.line, '[^\x20\x09-\x0D]+')) AS words
  FROM t LEFT JOIN s ON t.line = s.line),
d AS (
  SELECT doc_id, any_value(text) AS text, sum(CASE WHEN hit THEN words ELSE 0 END) AS w, sum(words) AS all_words,
         count(*) FILTER (WHERE line != '') AS n_lines FROM m GROUP BY 1),
twin AS (SELECT text FROM documents GROUP BY text HAVING count(*) > 1),
o AS (SELECT text, min(doc_id) AS doc_id FROM d WHERE w > 0.5 * all_words GROUP BY text),
f AS (SELECT m.text, m.line, lead(m.line) OVER (PARTITION BY m.text ORDER BY m.at) AS following FROM m JOIN o USING (doc_id) WHERE m.hit),
g AS (SELECT DISTINCT text, line, following FROM f WHERE following IS NOT NULL),
h AS (SELECT line, following, count(*) > 1 AS shared FROM g GROUP BY 1, 2),
c AS (
  SELECT text FROM g JOIN h USING (line, following) GROUP BY text HAVING avg(CASE WHEN shared THEN 1 ELSE 0 END) >= 0.5
  UNION SELECT text FROM o WHERE text IN (SELECT text FROM twin)),
ow AS (SELECT m.text, m.hit, regexp_extract_all(m.line, '[^\x20\x09-\x0D]+') AS w FROM m JOIN o USING (doc_id)),
ru AS (SELECT text, hit, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS run FROM ow),
r AS (SELECT text, run, bool_or(NOT hit) AS own FROM ru GROUP BY 1, 2),
rs AS (SELECT run, count(*) > 1 AS shared FROM r GROUP BY 1),
own AS (
  SELECT text FROM r JOIN rs USING (run) WHERE own GROUP BY text HAVING avg(CASE WHEN shared THEN 1 ELSE 0 END) >= 0.5
  UNION SELECT d.text FROM d JOIN o USING (doc_id) WHERE 9 * d.w >= 8 * d.all_words),
every AS (SELECT text FROM x WHERE source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) >= 5),
e AS (
  SELECT d.*, NOT (w > 0.5 * all_words AND (text IN (SELECT text FROM c) AND text IN (SELECT text FROM own) OR text IN (SELECT text FROM every))) AS cut FROM d),
k AS (
  SELECT m.doc_id, string_agg(m.raw, chr(10) ORDER BY m.at) FILTER (WHERE NOT (m.hit AND e.cut)) AS text,
         count(*) FILTER (WHERE m.line != '' AND m.hit AND e.cut) AS n_dropped
  FROM m JOIN e USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n_lines::BIGINT AS n_lines, k.n_dropped::BIGINT AS n_dropped,
       length(coalesce(k.text, ''))::BIGINT AS n_chars, md5(coalesce(k.text, '')) AS text_md5
FROM d JOIN k USING (doc_id)
"""
