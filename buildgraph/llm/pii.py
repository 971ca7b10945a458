"""Personal data: base patterns, and candidates that boosted trees select, in DataFrame functions only.

Base spans are leftmost matches of four patterns that pass a check of their own
(parts of an address, Luhn digits, number of digits).  They always stay.

High-recall generators propose more spans, which may overlap: any run of number-like
characters, and anything that looks like an address with a written-out or bracketed at sign.
Trees look at the format of a candidate (digits, separators, brackets, plus sign,
Luhn, groups) and at its context (characters and words beside it).  They learn
from the candidates of all documents: those that are base spans are positive, those
that failed the checks negative.  Per kind, the threshold is the least one with the wanted
precision on held-out documents.  Selected candidates are added where they overlap no span so far.

Patterns use possessive repeats and look at run starts only, so no text, however
long or regular, makes them backtrack or recurse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildgraph.functions.storage import materialize
from buildgraph.llm.boosting import calibrated_threshold, fit

KINDS = ("email", "ip", "card", "phone")
NAME = "A-Za-z0-9._%+-"
#: The base patterns, written without backtracking.
PATTERNS = {
    "email": rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Proposals; groups of digits with separators, and addresses in disguise.
GENERATORS = {
    "number": r"\+?+\(?+[0-9](?:[ ().-]{0,2}+[0-9]){6,40}+",
    "address": rf"(?:(?<![{NAME}])|\G)[{NAME}]++ ?+[(\[{{]at[)\]}}] ?+[A-Za-z0-9-]++(?: ?+(?:\.|[(\[{{]dot[)\]}}]) ?+[A-Za-z0-9-]++)++",
}
PRECISION = 0.995
NONE = "array<struct<start:bigint,end:bigint,s:string>>"


def matches(text: str, pattern: str, needed: Column) -> Column:
    """All matches of a pattern in column ``text`` as (start, end, s), in code points.

    A text between matches and the match itself have a length; starts are sums of these, taken over blocks of
    256 so that a text of very many matches does not cost their square.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    size = 256
    body = f"""
    transform(array(named_struct('p', split({text}, '{quoted}', -1), 'm', regexp_extract_all({text}, '{quoted}', 0))), x ->
      transform(array(named_struct('m', x.m, 'p', transform(x.p, v -> cast(length(v) as bigint)),
        'n', transform(x.m, (v, i) -> cast(length(v) + length(x.p[i]) as bigint)))), y ->
        transform(array(named_struct('y', y, 'b', IF(size(y.m) <= {size}, array(0L),
          transform(sequence(0, (size(y.m) - 1) div {size}), b -> aggregate(slice(y.n, b * {size} + 1, {size}), 0L, (a, c) -> a + c))))), z ->
          transform(array(IF(size(y.m) <= {size}, array(0L), transform(z.b, (v, i) -> IF(i = 0, 0L, aggregate(slice(z.b, 1, i), 0L, (a, c) -> a + c))))), o ->
            transform(y.m, (v, i) -> named_struct(
              'start', o[i div {size}] + IF(i % {size} = 0, 0L, aggregate(slice(y.n, (i div {size}) * {size} + 1, i % {size}), 0L, (a, c) -> a + c)) + y.p[i],
              's', v)))[0])[0])[0])[0]
    """
    found = F.transform(F.expr(body), lambda v: F.struct(v["start"].alias("start"), (v["start"] + F.length(v["s"])).alias("end"), v["s"].alias("s")))
    return F.when(needed, found).otherwise(F.array().cast(NONE))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    places = F.split(F.reverse(number), "")
    values = F.transform(
        places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(s, "\\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(s, "\\."), lambda p: F.substring(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), 1, 4).cast("int") <= 255
        )
    number = digits(s)
    if kind == "card":
        return F.length(number).between(16, 19) & luhn(number)
    return F.length(number).between(8, 15)


def checked(kind: str):
    """The check of a base match as a filter."""
    return lambda v: valid(kind, v["s"])


def ranked(rank: int):
    """A span with the rank of its kind."""
    return lambda v: F.struct(F.lit(rank).alias("rank"), v["start"].alias("start"), v["end"].alias("end"))


def of_rank(rank: int):
    return lambda v: v["rank"] == rank


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _t (text, null as empty) and the checked matches of each kind."""
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    t = F.col("_t")
    needed = {
        "email": t.contains("@"),
        "ip": F.col("_digit") & t.rlike("[0-9]\\.[0-9]"),
        "card": F.col("_digit"),
        "phone": F.col("_digit") & t.rlike("\\+[0-9]"),
    }
    rows = rows.withColumns({f"_{k}": matches("_t", PATTERNS[k], needed[k]) for k in KINDS})
    return rows.withColumns({f"_{k}": F.filter(f"_{k}", checked(k)) for k in KINDS})


def features(v: Column, t: Column) -> dict[str, Column]:
    """Numbers that describe a candidate and what stands beside it."""
    s, number = v["s"], digits(v["s"])
    before = F.substring(t, F.greatest(v["start"] - 23, F.lit(1)).cast("int"), F.least(v["start"], F.lit(24)).cast("int"))
    after = F.substring(t, (v["end"] + 1).cast("int"), 1)
    plain = F.lower(before)
    return {
        "digits": F.length(number),
        "size": F.length(s),
        "dots": F.length(F.regexp_replace(s, "[^.]", "")),
        "dashes": F.length(F.regexp_replace(s, "[^-]", "")),
        "spaces": F.length(F.regexp_replace(s, "[^ ]", "")),
        "brackets": F.length(F.regexp_replace(s, "[^()\\[\\]{}]", "")),
        "plus": s.startswith("+").cast("int"),
        "groups": F.size(F.split(s, "[^0-9]+")),
        "luhn": F.when(F.length(number) > 0, luhn(number)).otherwise(False).cast("int"),
        "joined_before": before.rlike("[A-Za-z0-9._@+-]$").cast("int"),
        "joined_after": after.rlike("^[A-Za-z0-9_@]").cast("int"),
        "phone_word": plain.rlike("tel|phone|call|mobil|fax|whatsapp").cast("int"),
        "card_word": plain.rlike("card|visa|credit|carte|karte|tarjeta").cast("int"),
        "mail_word": plain.rlike("mail|contact|kontakt|contacto").cast("int"),
        "net_word": plain.rlike("(^|[^a-z])(ip|host|server|addr)").cast("int"),
    }


def proposed(rows: DataFrame) -> DataFrame:
    """``rows`` with _candidates: (start, end, source, f: features)."""
    t = F.col("_t")
    rows = rows.withColumns(
        {
            "_number": matches("_t", GENERATORS["number"], F.col("_digit") & t.rlike("[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]")),
            "_address": matches("_t", GENERATORS["address"], t.rlike("[(\\[{]at[)\\]}]")),
        }
    )

    def described(source: str) -> Column:
        return F.transform(
            f"_{source}",
            lambda v: F.struct(
                v["start"].alias("start"),
                v["end"].alias("end"),
                F.struct(*[x.cast("double").alias(n) for n, x in features(v, t).items()], F.lit(float(source == "address")).alias("address")).alias("f"),
            ),
        )

    return rows.withColumn("_candidates", F.concat(described("number"), described("address")))


def overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


FEATURES = [
    "digits", "size", "dots", "dashes", "spaces", "brackets", "plus", "groups", "luhn", "joined_before", "joined_after",
    "phone_word", "card_word", "mail_word", "net_word", "address",
]


def learned(docs: DataFrame, doc_id: str, text: str) -> dict[str, tuple[str, float]]:
    """Probability expression over ``c.f`` and threshold of each kind, from the candidates of all documents.

    Trees learn from two thirds of the documents, by a hash of their ids; thresholds come from the others.  A kind whose precision cannot be reached adds nothing (threshold above 1).
    """
    rows = proposed(base_spans(docs.select(doc_id, text), text))
    each = rows.select(F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(3)).alias("fold"), *[f"_{k}" for k in KINDS], F.explode("_candidates").alias("c"))
    flat = each.select("fold", *[F.exists(f"_{k}", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end"))).cast("int").alias(f"y_{k}") for k in KINDS], "c.f.*")
    flat = materialize(flat, "pii-candidates")
    out = {}
    for kind in KINDS:
        score = fit(flat.where("fold > 0"), FEATURES, f"y_{kind}", trees=10)
        held = flat.where("fold = 0").withColumn("score", F.expr(score))
        out[kind] = (score, calibrated_threshold(held, "score", f"y_{kind}", PRECISION))
    return out


def with_prefix(sql: str, prefix: str) -> str:
    """The expression with each feature taken from a struct."""
    for name in FEATURES:
        sql = sql.replace(f"IF({name} <=", f"IF({prefix}{name} <=")
    return sql


def find_pii(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``keep`` with _base and _spans: arrays of (rank of kind, start, end), in that order.

    Null and empty texts have none.  Repeated rows get the same spans.
    """
    models = learned(docs, doc_id, text)
    rows = proposed(base_spans(docs.select(*{*keep, text}), text))
    base = F.concat(*[F.transform(f"_{k}", ranked(r)) for r, k in enumerate(KINDS)])
    rows = rows.withColumn("_base", base)
    free = F.filter("_candidates", lambda c: ~overlaps(c, F.col("_base")))
    rows = rows.withColumn("_free", free)
    chosen = []
    for rank, kind in enumerate(KINDS):
        sql, threshold = models[kind]
        if threshold > 1:
            continue
        hit = F.expr(f"filter(_free, c -> {with_prefix(sql, 'c.f.')} >= {threshold!r}D)")
        chosen.append(F.transform(hit, ranked(rank)))
    if chosen:
        rows = rows.withColumn("_more", F.array_sort(F.concat(*chosen)))
        # The kind listed first wins where several chose one candidate, or candidates overlap.
        more = F.filter("_more", lambda c, i: ~F.exists(F.slice("_more", 1, i), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        spans = F.array_sort(F.concat("_base", more))
    else:
        spans = F.col("_base")
    return rows.withColumn("_spans", spans).select(*keep, "_base", "_spans")


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", F.get(names, v["rank"]), v["start"].cast("string"), v["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets."""
    order = F.array_sort(F.transform(spans, lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["rank"].alias("rank"))))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    step = lambda a, v: F.when(
        v["start"] >= a["at"],
        F.struct(v["end"].alias("at"), F.array_append(F.array_append(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (v["start"] - a["at"]).cast("int"))), F.get(names, v["rank"])).alias("out")),
    ).otherwise(a)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    end = lambda a: F.array_join(F.array_append(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))), "")
    return F.when(text.isNotNull(), F.aggregate(order, start, step, end))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's digest columns."""
    found = find_pii(docs.select("doc_id", "text"), ["doc_id"])
    counts = [F.size(F.filter("_base", of_rank(r))).cast("long").alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("_base")), 256).alias("base_sha256"), digest(F.col("_spans")).alias("spans"))
