"""Personal data by patterns, and information-theoretic sanitisation of the terms around it, in DataFrame operations alone.

Patterns give the protected entities: mail and network addresses, card and phone numbers. A term is a word of two letters
or more, in any case. Over all documents, with N rows, n_c of them holding the entity c, n_t holding the term t and n_ct
holding both, wherever in the document, what t discloses of c is

    disclosure = PMI(c; t) / IC(c) = log(N * n_ct / (n_c * n_t)) / log(N / n_c),

1 if t never occurs without c. As PMI / IC = 1 + log(n_ct / n_t) / IC, all that is estimated is the share n_ct / n_t.
With an entity held by ``support`` different texts or more a term must have been seen in as many; with a rarer one, which
most personal data are, in each of its texts. Seen in fewer than ``support`` texts the share is taken as
min(n_ct / n_t, (n_ct + 1) / (n_t + 2)), the rule of succession where that is lower: it takes off at most log(3/2) / IC(c),
and such a term is never removed. Terms at ``generalise_at`` or more are generalised to a note of the entity's kind; those at
``remove_at`` or more are removed, at every place in the documents that hold the entity. Entities are not limited to documents
of any kind. Each distinct entity of a document meets each of its distinct terms that can reach ``generalise_at`` by n_c and n_t
alone, which leaves out no pair that counts; common words drop out before pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# What each kind looks like. Starts in the middle of a run of characters are ruled out and repetitions are
# possessive, which changes no match and keeps the time in proportion to the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}{2,}"
_SPAN = "struct<s:int,e:int,v:string>"


def spans(text: str, pattern: str) -> str:
    """SQL for the matches of ``pattern`` as structs (s, e, v): first and last code point (exclusive), and the match.

    ``split`` gives the stretches between the matches, so the places are sums of lengths; they are added up in blocks, as an
    array grows by copying."""
    p = f"r'{pattern}'"
    step = "named_struct('at', c.at + length(p[i]) + length(m[i]), 'out', concat(c.out, array(named_struct('s', c.at + length(p[i]), 'e', c.at + length(p[i]) + length(m[i]), 'v', m[i]))))"
    block = f"aggregate(sequence(k * 256, least(size(m), (k + 1) * 256) - 1), named_struct('at', b.at, 'out', cast(array() as array<{_SPAN}>)), (c, i) -> {step})"
    summed = f"aggregate(sequence(0, (size(m) - 1) div 256), named_struct('at', 0, 'out', cast(array() as array<array<{_SPAN}>>)), (b, k0) -> element_at(transform(array(cast(k0 as int)), k -> element_at(transform(array({block}), r -> named_struct('at', r.at, 'out', concat(b.out, array(r.out)))), 1)), 1), x -> flatten(x.out))"
    return f"element_at(transform(array(regexp_extract_all({text}, {p}, 0)), m -> if(size(m) = 0, cast(array() as array<{_SPAN}>), element_at(transform(array(split({text}, {p}, -1)), p -> {summed}), 1))), 1)"


def _valid(kind: str) -> str:
    """SQL over a span x: does the match pass the checks of its kind."""
    luhn = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + element_at(transform(array(cast(substring(d, length(d) - i + 1, 1) as int) * if(i % 2 = 0, 2, 1)), y -> if(y > 9, y - 9, y)), 1)) % 10 = 0"
    return {
        "email": "true",
        "ip": r"forall(transform(split(x.v, r'\.'), y -> regexp_replace(y, r'^0+', '')), y -> length(y) < 3 or (length(y) = 3 and y <= '255'))",
        "card": f"exists(array(translate(x.v, ' -', '')), d -> if(length(d) between 16 and 19, {luhn}, false))",
        "phone": "length(regexp_replace(x.v, r'[^0-9]', '')) between 8 and 15",
    }[kind]


def found(text: str) -> Column:
    """A struct with an array of valid spans for each kind."""
    parts = []
    for kind, pattern in PATTERNS.items():
        made = f"filter({spans(text, pattern)}, x -> {_valid(kind)})"
        if HINTS[kind]:
            made = f"if(contains({text}, '{HINTS[kind]}'), {made}, cast(array() as array<{_SPAN}>))"
        parts += [f"'{kind}'", made]
    return F.expr(f"named_struct({', '.join(parts)})")


def _written(column: str) -> str:
    """SQL for ``kind:start:end`` of all spans of a struct as ``found`` gives."""
    return "flatten(array(" + ", ".join(f"transform({column}.{k}, x -> concat('{k}:', x.s, ':', x.e))" for k in PATTERNS) + "))"


def sanitise(docs: DataFrame, support: int = 3, generalise_at: float = 0.9, remove_at: float = 0.995, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_email, n_ip, n_card, n_phone, base, terms, redacted.

    ``base`` is the written spans of the patterns, ``terms`` an array of (s, e, action, kind), ``redacted`` the text with
    entities and disclosing terms replaced. With ``carry`` the result is ``docs`` with its text column redacted, whatever the
    names of its columns. Null texts count as empty and stay null in ``redacted``. Rows may repeat; equal rows have equal
    results. An empty table gives no rows. Rows without an entity pass through: only those with one are stored or shuffled."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    named = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text"), *row)
    named = named.withColumn("_t", F.coalesce("_text", F.lit(""))).withColumn("_f", found("_t")).drop("_t")
    some = " or ".join(f"size(_f.{k}) > 0" for k in PATTERNS)
    every = "array_sort(flatten(array(" + ", ".join(f"transform(_f.{k}, x -> named_struct('s', x.s, 'e', x.e, 'kind', '{k}', 'v', x.v))" for k in PATTERNS) + ")))"
    # only documents that hold an entity can change, so the rest is neither stored nor shuffled
    stored = shared.settle(named.where(some).withColumns({"_uid": F.monotonically_increasing_id(), "_all": F.expr(every)}), "pii-held")
    n, th = docs.count(), F.xxhash64("_text").alias("th")
    held = stored.select("_uid", th, F.explode(F.expr("array_distinct(transform(_all, x -> named_struct('kind', x.kind, 'v', x.v)))")).alias("c")).select("_uid", "th", "c.*")
    entities = held.groupBy("kind", "v").agg(F.count("*").alias("n_c"), F.count_distinct("th").alias("texts_c")).where(F.col("n_c") < n)
    entities = shared.settle(entities, "pii-entities")
    # with n_ct <= min(n_c, n_t) no term in more rows than this can reach generalise_at beside any entity
    most = entities.agg(F.max("n_c")).first()[0] or 1
    bound = n ** (1 - generalise_at) * most**generalise_at * (1 + 1e-9) if n else 0
    distinct = F.array_distinct(F.transform(F.expr(f"regexp_extract_all(_text, r'{WORD}', 0)"), F.lower))
    terms = docs.select(F.col(text_col).cast("string").alias("_text")).select(F.explode(distinct).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= bound)
    own = held.join(entities, ["kind", "v"]).groupBy("_uid", "th").agg(F.collect_list(F.struct("kind", "v", "n_c", "texts_c")).alias("cs"))
    likely = F.filter("cs", lambda c: n * F.least(c["n_c"], F.col("n_t")) / (c["n_c"].cast("double") * F.col("n_t")) >= F.pow(n / c["n_c"], F.lit(generalise_at)) * (1 - 1e-9))
    words = stored.select("_uid", F.explode(F.expr(spans("_text", WORD))).alias("x")).select("_uid", F.lower("x.v").alias("term"), "x.s", "x.e")
    words = words.join(terms, "term").repartition("_uid").groupBy("_uid", "term", "n_t").agg(F.collect_list(F.struct("s", "e")).alias("places")).join(own, "_uid")
    pairs = words.select("_uid", "th", "term", "n_t", "places", F.explode(likely).alias("c")).select("_uid", "th", "term", "n_t", "places", "c.*")
    pairs = shared.settle(pairs, "pii-pairs")
    pair = ["kind", "v", "term", "n_c", "texts_c", "n_t"]
    told = pairs.groupBy(*pair, "th").agg(F.count("*").alias("rows")).groupBy(*pair).agg(F.sum("rows").alias("n_ct"), F.count("*").alias("texts"))
    told = told.where(F.col("texts") >= F.least(F.lit(support), F.col("texts_c")))
    often, raw = F.col("texts") >= support, F.col("n_ct") / F.col("n_t")
    share = F.when(often, raw).otherwise(F.least(raw, (F.col("n_ct") + 1) / (F.col("n_t") + 2)))
    told = told.withColumn("disclosure", F.log(n * share / F.col("n_c")) / F.log(n / F.col("n_c")))
    told = told.where(F.col("disclosure") >= generalise_at).select("kind", "v", "term", F.when(often & (F.col("disclosure") >= remove_at), "remove").otherwise("generalise").alias("action"))
    at = pairs.join(told, ["kind", "v", "term"]).select("_uid", F.explode("places").alias("x"), "action", "kind").select("_uid", "x.*", "action", "kind")
    marked = shared.settle(at.groupBy("_uid").agg(F.array_sort(F.collect_set(F.struct("s", "e", "action", "kind"))).alias("_terms")), "pii-marked")
    shared.discard(entities, pairs)
    out = stored.join(marked, "_uid", "left")
    clear = f"element_at(transform(array({every}), bs -> filter(_terms, t -> not exists(bs, b -> t.s < b.e and b.s < t.e))), 1)"
    out = out.withColumn("terms", F.expr(f"if(_terms is null, cast(array() as array<struct<s:int,e:int,action:string,kind:string>>), {clear})"))
    labels = f"array_sort(concat(transform({every}, x -> named_struct('s', x.s, 'e', x.e, 'l', concat('[', upper(x.kind), ']'))), transform(terms, x -> named_struct('s', x.s, 'e', x.e, 'l', if(x.action = 'remove', '', concat('[near ', x.kind, ']'))))))"
    cut = "aggregate(ls, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> if(x.s >= a.at, named_struct('at', x.e, 'out', concat(a.out, array(substring(_text, a.at + 1, x.s - a.at), x.l))), named_struct('at', greatest(a.at, x.e), 'out', a.out)), a -> concat(array_join(a.out, ''), substring(_text, a.at + 1)))"
    redacted = F.expr(f"element_at(transform(array({labels}), ls -> if(size(ls) = 0, _text, {cut})), 1)")
    rest = named.where(f"not ({some})")
    if carry:
        own_row = lambda df, changed: df.select(*[changed.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
        return own_row(out, redacted).union(own_row(rest, F.col("_text")))
    counts = [F.size(f"_f.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    none = F.expr("cast(array() as array<struct<s:int,e:int,action:string,kind:string>>)").alias("terms")
    rest = rest.select(F.col("_doc").alias("doc_id"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in PATTERNS], F.lit("").alias("base"), none, F.col("_text").alias("redacted"))
    return out.select(F.col("_doc").alias("doc_id"), *counts, F.array_join(F.expr(_written("_f")), ",").alias("base"), "terms", redacted.alias("redacted")).union(rest)
