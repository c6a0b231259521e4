"""Personal data: base patterns, and contexts that are learned from what they find.

Base spans are the leftmost non-overlapping matches of a kind's pattern that pass its check.
Spark gives matches and gaps but no offsets; offsets are running sums of the lengths of both.

The bootstrapped part looks at identifiers: words with a digit or an at sign. Its seeds are
the identifiers that a base span covers. The two words before an identifier are its lexical
pattern. Pattern and instance form a bipartite graph, aggregated over the whole corpus before
it is scored: a pattern's score is the share of its distinct instances that are seeds or that
other patterns have discovered. A pattern with enough of these and a high score discovers all
identifiers that follow it; they get the kind ``id`` there, and count for other patterns in the
next round. Rounds go on until nothing is added. No pattern counts what it discovers itself.

Everything is DataFrame expressions; only documents with candidates are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descry.llm.common import DOC, TEXT, exactly, stored

#: The kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
#: The patterns of the kinds. Possessive repeats and the look-behind change no
#: match (no repeat can give back what the next part needs, and a match starts at the head of
#: its run, or where the last one ended); they keep long runs from costing their square, and
#: from deep recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to match at all.
NEEDS = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
IDENTIFIER = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{6,64}(?!\S)"
SUPPORT = 5  # distinct seeds and discovered instances of a pattern
CONFIDENCE = 0.8


CHUNK = 64


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use).getItem(0)


def _before(items: Column, measure, plus) -> Column:
    """array<struct<item, before>>: ``before`` folds the measures of all earlier items from 0.

    Items are taken in chunks, so the work grows with their number times ``CHUNK``."""
    fold = lambda xs, f: F.aggregate(xs, F.lit(0), lambda a, x: plus(a, f(x)))
    one = lambda chunk, base: F.transform(chunk, lambda x, i: F.struct(
        x.alias("item"), plus(base, fold(F.slice(chunk, F.lit(1), i), measure)).alias("before")))
    each = lambda chunks, totals: F.flatten(F.transform(chunks, lambda chunk, c: _bound(
        fold(F.slice(totals, F.lit(1), c), lambda t: t), lambda base: one(chunk, base))))
    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")),
                                 lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
    return _bound(cut(items), lambda chunks: _bound(
        F.transform(chunks, lambda ch: fold(ch, measure)), lambda totals: each(chunks, totals)))


def _matches(pattern: str, text: Column) -> Column:
    """array<struct<start, end, match, gap>> of all matches in order, offsets in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    parts = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(
        m.alias("match"), g.alias("gap"), F.length(m).alias("size"), F.length(g).alias("skip")))
    placed = _before(parts, lambda x: x["size"] + x["skip"], lambda a, b: a + b)
    return F.transform(placed, lambda p: F.struct(
        (p["before"] + p["item"]["skip"]).alias("start"),
        (p["before"] + p["item"]["skip"] + p["item"]["size"]).alias("end"),
        p["item"]["match"].alias("match"), p["item"]["gap"].alias("gap")))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike(
            r"^0*+(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _bound(_digits(match), lambda d: F.when(
            F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(kind: str, text: Column) -> Column:
    order = KINDS.index(kind)
    valid = F.filter(_matches(PATTERNS[kind], text), lambda m: _passes(kind, m["match"]))
    made = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"),
                                                 m["end"].alias("end")))
    return F.when(text.rlike(NEEDS[kind]) & text.rlike(PATTERNS[kind]), made.cast(SPANS)).otherwise(
        F.array().cast(SPANS))


def _base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[_spans(k, F.coalesce(text, F.lit(""))) for k in KINDS]))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _instances(text: Column) -> Column:
    """Identifiers with the two lower-case words before them; none where there are not two."""
    located = _matches(IDENTIFIER, text)
    pattern = lambda gap: F.regexp_extract(F.lower(F.right(gap, F.lit(80))), r"(\S+\s+\S+)\s+$", 1)
    made = F.transform(located, lambda m: F.struct(
        m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"),
        m["match"].alias("instance"), pattern(m["gap"]).alias("pattern")))
    kind = "array<struct<start:int,end:int,instance:string,pattern:string>>"
    return F.when(text.rlike("[0-9@]"), F.filter(made, lambda x: x["pattern"] != "").cast(kind)
                  ).otherwise(F.array().cast(kind))


def located(docs: DataFrame, key: str = DOC) -> DataFrame:
    """(row, key, spans, instances) of every document, stored: base spans in order, and all
    identifiers with their lexical patterns."""
    plain = exactly(docs, key, TEXT)
    return stored(plain.select(F.monotonically_increasing_id().alias("row"), key,
                               _base_spans(F.col(TEXT)).alias("spans"),
                               _instances(F.coalesce(TEXT, F.lit(""))).alias("instances")), "spans")


def instances_in(found: DataFrame) -> int:
    """How many identifiers all texts hold: a bound of the rows of their graph."""
    return found.agg(F.sum(F.size("instances"))).first()[0] or 0


def discovered(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, instance): identifiers that confident patterns discover, seeds left out."""
    rows = instances_in(found)
    edges = (found.select("spans", F.explode("instances").alias("x"))
             .select(F.col("x.pattern").alias("pattern"), F.col("x.instance").alias("instance"),
                     F.exists("spans", lambda s: (s["start"] < F.col("x.end"))
                              & (s["end"] > F.col("x.start"))).alias("seed"))
             .groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    edges = stored(edges, "edges", rows)
    # Other patterns can never have the support, or have nothing to discover.
    able = (edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(~F.col("seed")).alias("open"))
            .filter((F.col("n") >= support) & (F.col("open") > 0)).select("pattern"))
    seeds = edges.filter("seed").select("instance").distinct().withColumn("new", F.lit(True))
    known = lambda graph, new: graph.join(new, "instance", "left").withColumn(
        "known", F.col("known") | F.coalesce("new", F.lit(False))).drop("new")
    graph = stored(known(edges.join(able, "pattern").withColumn("known", F.lit(False)), seeds), "graph", rows)
    while True:
        trusted = (graph.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if("known").alias("k"))
                   .filter((F.col("k") >= support) & (F.col("k") >= confidence * F.col("n"))).select("pattern"))
        new = stored(graph.filter("not known").join(trusted, "pattern").select("instance").distinct()
                     .withColumn("new", F.lit(True)), "accepted", rows)
        if new.isEmpty():
            return graph.filter("not seed").join(trusted, "pattern").select("pattern", "instance")
        graph = stored(known(graph, new), "graph", rows)


def discovered_spans(found: DataFrame, key: str) -> DataFrame | None:
    """(key, extra) of the documents in which identifiers are discovered; None if nowhere."""
    new = stored(discovered(found), "discovered", instances_in(found))
    if new.isEmpty():
        return None
    return (found.select(key, "spans", F.explode("instances").alias("x"))
            .select(key, "spans", "x.*").join(new, ["pattern", "instance"])
            .filter(~F.exists("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
            .groupBy(key).agg(F.collect_set(F.struct(
                "start", F.lit(len(KINDS)).alias("kind"), "end")).cast(SPANS).alias("extra")))


def _all_spans(df: DataFrame, spans: Column, key: str, extra: DataFrame | None) -> DataFrame:
    if extra is None:
        return df.withColumn("all_spans", spans)
    none = F.array().cast(SPANS)
    return df.join(extra, key, "left").withColumn(
        "all_spans", F.array_sort(F.concat(spans, F.coalesce("extra", none)))).drop("extra")


def _counted(kind: str) -> Column:
    order = KINDS.index(kind)
    return F.size(F.filter("spans", lambda s: s["kind"] == order)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.

    Counts and base_sha256 are those of base spans; ``spans`` lists all as kind:start:end by
    start, then kind, discovered ones as ``id``. A null text is empty; texts without personal
    data list nothing. Repeated rows and null doc_ids are answered row by row; other columns
    are ignored; an empty table gives an empty table.
    """
    base = located(docs)
    found = _all_spans(base, F.col("spans"), "row", discovered_spans(base, "row"))
    counts = [_counted(k).alias(f"n_{k}") for k in KINDS]
    return found.select(DOC, *counts, F.sha2(_listed(F.col("spans")), 256).alias("base_sha256"),
                        _listed(F.col("all_spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Where spans overlap, the first names the place and all of it goes. Texts without spans,
    and null texts, stay as they are.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index(TEXT)}"
    # Spans depend on the text alone, so the texts need not be numbered, stored or shuffled.
    keyed = plain.withColumn("key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    base = located(keyed.select("key", F.col(text).alias(TEXT)), "key")
    extra = discovered_spans(base, "key")
    joined = _all_spans(keyed, _base_spans(F.col(text)), "key", extra)
    later = lambda a, b: F.greatest(a, b)
    labels = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, FOUND)])
    merged = F.filter(_before(F.col("all_spans"), lambda s: s["end"], later),
                      lambda p: (p["item"]["end"] > p["before"]))
    pieces = F.transform(merged, lambda p: F.when(p["item"]["start"] < p["before"], F.lit("")).otherwise(
        F.concat(F.substring(F.col(text), p["before"] + 1, p["item"]["start"] - p["before"]),
                 labels[p["item"]["kind"]])))
    rest = F.substring(F.col(text), F.array_max(F.transform("all_spans", lambda s: s["end"])) + 1,
                       F.length(text))
    masked = F.when(F.coalesce(F.size("all_spans"), F.lit(0)) == 0, F.col(text)).otherwise(
        F.concat(F.array_join(pieces, ""), rest))
    return joined.withColumn(text, masked).select(*plain.columns).toDF(*names)
