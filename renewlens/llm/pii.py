"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are the spans of four base patterns (email, ip, card with Luhn, phone). The
words around seeds, and around candidates that no base pattern covers, are lexical
patterns. Candidates are written-out or bracketed at-forms (with or without digits),
runs of digit groups joined by blanks, dots, slashes, hyphens and brackets, groups of
hexadecimal digits joined by colons, and single tokens with three digits. Patterns and
instances form a graph that is scored in turns: a pattern's confidence in a kind is the
share of its occurrences taken by instances of that kind, among seeds and candidates of
the kind's shape; an instance's score the mean
confidence of the patterns it occurs in, for the kinds whose shape it has (SHAPES).
Only patterns seen with several different seeds count. Candidates whose score reaches
the limit after the last turn are added as spans of the kind; base spans stay.

Offsets are code points, from the lengths of the pieces between matches. Rows: a
null text counts as empty; repeated rows give repeated rows; a text without a match
gives empty strings; with no seeds at all nothing is added; an empty table gives no
rows; very long texts are searched whole. Patterns are possessive
where that cannot change a match, so long runs are read in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import named, select_as, table, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Base patterns: what they match is fixed; the look-behinds only skip starts that cannot match.
REGEX = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?: ?[(\[{<] ?(?i:at|@) ?[)\]}>] ?| (?i:at) |@)"
_DOT = r"(?:\.| ?[(\[{<] ?(?i:dot|punkt|punto|point) ?[)\]}>] ?| (?i:dot) )"
_NAME = r"[\p{L}0-9_%+-]"
#: An at-form; a blank " at " counts only with a domain of two parts behind it.
_MAIL = rf"{_NAME}{{1,64}}+(?:{_DOT}{_NAME}{{1,64}}+){{0,8}}(?:{_AT})[\p{{L}}0-9-]{{1,63}}+(?:{_DOT}[\p{{L}}0-9-]{{1,63}}+){{0,8}}+"
_HEX = r"[0-9A-Fa-f]{1,4}+(?::{1,2}[0-9A-Fa-f]{1,4}+){2,7}+"
_RUN = r"[+(]?[0-9](?:[ ()./-]{0,2}+[0-9]){5,30}+"
_TOKEN = r"(?=(?:[^\s0-9]{0,40}[0-9]){3})[A-Za-z0-9+][A-Za-z0-9+@._%()/:#=-]{4,38}(?<=[A-Za-z0-9])"
#: Candidates, each after a blank, an opening mark or a colon, and before a blank or closing marks.
SLOT = rf"(?<![^\s(<\[\"':=])(?:{_MAIL}|{_HEX}|{_RUN}|{_TOKEN})(?=[.,;:!?)>\]\"']{{0,3}}(?:\s|$))"
#: What a candidate must look like to be taken for a kind: a form, and how many digits.
SHAPES = {
    "email": (rf"[@(\[{{<]| (?i:at) .*{_DOT}|\.\p{{L}}{{2,}}$", 0, 64),
    "ip": (rf"^[0-9]{{1,3}}(?:[ ._:-][0-9]{{1,3}}){{2,3}}(?:/[0-9]{{1,2}})?$|^{_HEX}(?:/[0-9]{{1,3}})?$", 1, 64),
    "card": (r"^[0-9][0-9 ./-]*$", 12, 19),
    "phone": (r"^[+(0-9][0-9 ()./-]*$", 6, 15),
}
CONTEXT = 24
TURNS = 3
#: Different seeds a pattern needs before it counts for a kind.
MIN_SEEDS = 3
#: Score from which an instance is taken as an identifier of the kind.
LIMIT = 0.8
#: Added to a pattern's occurrences, so rare patterns stay below the limit.
SMOOTH = 0.5

_CHUNK = 256


def _found(text: Column, regex: str, guard: Column) -> tuple[Column, Column]:
    """The pieces around all matches, and the matches."""
    return (F.when(guard, F.split(text, regex, -1)), F.when(guard, F.regexp_extract_all(text, F.lit(regex), F.lit(0))))


def _lengths(parts: Column, matches: Column) -> Column:
    """Code points of each piece with its match."""
    return F.transform(matches, lambda m, i: (F.length(m) + F.length(F.get(parts, i))).cast("long"))


def _sums(lens: Column) -> Column:
    """Sum of ``lens`` before each run of _CHUNK."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(lens) / _CHUNK).cast("int")),
                       lambda c: F.aggregate(F.slice(lens, F.lit(1), c * _CHUNK), F.lit(0).cast("long"), lambda a, x: a + x))


def _placed(parts: Column, matches: Column, lens: Column, sums: Column) -> Column:
    """array<struct<s, e, m, l, r>>: start and end of each match, itself, the words beside it.

    ``lens`` and ``sums`` must be columns of the input: inside a lambda an expression is made anew per element.
    """

    def place(m, i):
        before = F.get(sums, F.floor(i / _CHUNK).cast("int")) + F.aggregate(
            F.slice(lens, i - i % _CHUNK + 1, i % _CHUNK), F.lit(0).cast("long"), lambda a, x: a + x)
        start = before + F.length(F.get(parts, i))
        left = F.lower(F.substring(F.get(parts, i), -64, 64))
        right = F.lower(F.substring(F.get(parts, i + 1), 1, 64))
        return F.struct(
            start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"),
            F.regexp_extract(left, rf"(\S{{1,{CONTEXT}}}+)(?:\s+|(?<=[:=]))[(<\[\"']?$", 1).alias("l"),
            F.regexp_extract(right, rf"^[^\s\p{{L}}0-9]{{0,3}}\s+(\S{{1,{CONTEXT}}}+)", 1).alias("r"))

    return F.when((F.size(lens) > 0) & (F.size(sums) > 0), F.transform(matches, place))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(_digits(m))
    value = F.transform(F.split(d, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))))
    total = F.aggregate(value, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.when(
            F.length(F.regexp_replace(p, "^0+", "")) <= 3,
            F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _valid(kind, x["m"])


def _named_span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def base_spans(docs: DataFrame) -> DataFrame:
    """``_text`` with the columns ``email, ip, card, phone`` (valid spans) and ``slot`` (candidates)."""
    text = F.coalesce("_text", F.lit(""))
    digit = text.rlike("[0-9]")
    guard = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+"),
             "slot": digit | text.rlike(r"@|(?i:\bat\b)")}
    kinds = (*KINDS, "slot")
    raw = docs
    for kind, regex in [*REGEX.items(), ("slot", SLOT)]:
        parts, matches = _found(text, regex, guard[kind])
        raw = raw.withColumns({f"_{kind}_p": parts, f"_{kind}_m": matches})
    raw = raw.withColumns({f"_{k}_l": _lengths(F.col(f"_{k}_p"), F.col(f"_{k}_m")) for k in kinds})
    raw = raw.withColumns({f"_{k}_s": _sums(F.col(f"_{k}_l")) for k in kinds})
    at = {k: _placed(*[F.col(f"_{k}_{x}") for x in "pmls"]) for k in kinds}
    placed = raw.withColumns({k: F.filter(at[k], _check(k)) if k in KINDS else at[k] for k in kinds})
    placed = placed.drop(*[f"_{k}_{x}" for k in kinds for x in "pmls"])
    return placed.withColumn("slot", F.filter("slot", lambda x: ~_overlaps(x)))


def _overlaps(x: Column) -> Column:
    """Whether a span meets any base span of its row."""
    hit = F.lit(False)
    for kind in KINDS:
        hit = hit | F.coalesce(F.exists(kind, lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])), F.lit(False))
    return hit


def _shaped(kind: str, m: Column) -> Column:
    form, low, high = SHAPES[kind]
    return m.rlike(form) & F.length(_digits(m)).between(low, high)


def _edges(spans: DataFrame) -> DataFrame:
    """(pat, inst, seed, n, ok_*): how often each instance occurs in each pattern; seed is the kind or null,
    ok_* tells whether a candidate has the kind's shape."""
    seen = None
    for kind in (*KINDS, "slot"):
        one = (spans.select(F.explode(kind).alias("x"))
               .select(F.xxhash64(F.lower("x.m")).alias("inst"), F.lit(kind if kind != "slot" else None).cast("string").alias("seed"),
                       F.col("x.l").alias("l"), F.col("x.r").alias("r"),
                       *[(_shaped(k, F.lower("x.m")) if kind == "slot" else F.lit(False)).alias(f"ok_{k}") for k in KINDS]))
        seen = one if seen is None else seen.union(one)
    pats = F.array(
        F.when(F.col("l") != "", F.xxhash64(F.lit("L"), "l")), F.when(F.col("r") != "", F.xxhash64(F.lit("R"), "r")),
        F.when((F.col("l") != "") & (F.col("r") != ""), F.xxhash64(F.lit("B"), "l", "r")))
    oks = [f"ok_{k}" for k in KINDS]
    return (seen.select("inst", "seed", *oks, F.explode(pats).alias("pat")).where("pat is not null")
            .groupBy("pat", "inst", "seed", *oks).agg(F.count(F.lit(1)).alias("n")))


def discovered(spans: DataFrame, turns: int = TURNS, min_seeds: int = MIN_SEEDS, limit: float = LIMIT) -> DataFrame:
    """(inst, kind): token hashes that confident patterns take for identifiers of a kind."""
    edges = written(_edges(spans), "pii-edges")
    # Only patterns that saw enough different seeds of one kind can add anything; all their edges are kept.
    strong = (edges.where("seed is not null").groupBy("pat", "seed").agg(F.countDistinct("inst").alias("seeds"))
              .where(F.col("seeds") >= min_seeds).select("pat").distinct())
    live = written(edges.join(strong, "pat", "left_semi").select(
        "pat", "inst", "n", *[F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"seed_{k}") for k in KINDS],
        F.col("seed").isNotNull().alias("is_seed"), *[f"ok_{k}" for k in KINDS]), "pii-graph")
    scores = None
    for _ in range(turns):
        now = live if scores is None else live.join(scores, "inst", "left")
        part = [(F.when(F.col("is_seed"), F.col(f"seed_{k}")).otherwise(
            F.lit(0.0) if scores is None else F.coalesce(f"i_{k}", F.lit(0.0)))).alias(f"v_{k}") for k in KINDS]
        conf = now.select("pat", "n", "is_seed", *[f"ok_{k}" for k in KINDS], *part).groupBy("pat").agg(
            *[(F.sum(F.col("n") * F.col(f"v_{k}"))
               / (F.sum(F.when(F.col("is_seed") | F.col(f"ok_{k}"), F.col("n")).otherwise(0)) + SMOOTH)).alias(f"p_{k}")
              for k in KINDS])
        scores = (live.where("not is_seed").join(conf, "pat").groupBy("inst").agg(
            *[(F.sum(F.when(F.col(f"ok_{k}"), F.col("n") * F.col(f"p_{k}")).otherwise(0.0)) / F.sum("n")).alias(f"i_{k}")
              for k in KINDS]))
        scores = written(scores, "pii-scores")
    best = F.greatest(*[F.col(f"i_{k}") for k in KINDS])
    kind = F.coalesce(*[F.when(F.col(f"i_{k}") == best, F.lit(k)) for k in KINDS])
    return scores.where(best >= limit).select("inst", kind.alias("kind"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: ``doc_id``, the columns of ``keep``, ``base`` and ``added``: array<struct<kind, s, e>>,
    each in the order of kinds, then starts."""
    src = select_as(docs, id_col, text_col, keep).withColumn("_row", F.monotonically_increasing_id())
    spans = written(base_spans(src).drop("_text"), "pii-spans")  # rows keep their number from here on
    new = discovered(spans)
    hits = (spans.where(F.size("slot") > 0).select("_row", F.explode("slot").alias("x"))
            .select("_row", "x.s", "x.e", F.xxhash64(F.lower("x.m")).alias("inst")).join(new, "inst")
            .groupBy("_row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added")))
    base = F.concat(*[F.transform(F.coalesce(k, F.array().cast(spans.schema[k].dataType)), _named_span(k)) for k in KINDS])
    both = spans.join(hits, "_row", "left").withColumn("base", base)
    added = F.coalesce("added", F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>"))
    return both.select(*named(id_col, keep), "base", _ordered(added).alias("added"))


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    tagged = F.transform(spans, lambda x: F.struct(rank[x["kind"]].alias("o"), x["s"].alias("s"), x["e"].alias("e"),
                                                   x["kind"].alias("kind")))
    return F.transform(F.array_sort(tagged), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; overlapping spans
    are replaced once, by the kind that starts first."""
    others = tuple(docs.columns)
    found = find(docs, id_col, text_col, keep=others)
    inner = found.toDF("_id", *[f"_c{i}" for i in range(len(others))], "base", "added")
    text = F.col(f"_c{others.index(text_col)}")
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(
        x["s"].alias("s"), (-x["e"]).alias("d"), x["e"].alias("e"), x["kind"].alias("kind"))))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,kind:string>>")
    apart = F.aggregate(spans, empty, lambda a, x: F.when(
        (F.size(a) > 0) & (F.get(a, F.size(a) - 1)["e"] > x["s"]), a).otherwise(
        F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))))
    marked = inner.withColumn("apart", F.when(F.size(spans) > 0, apart))

    def piece(x, i):
        start = F.when(i == 0, F.lit(0).cast("bigint")).otherwise(F.get("apart", i - 1)["e"])
        return F.concat(F.substring(text, (start + 1).cast("int"), (x["s"] - start).cast("int")),
                        F.lit("["), F.upper(x["kind"]), F.lit("]"))

    tail = F.substring(text, (F.element_at("apart", -1)["e"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col("apart").isNull(), text).otherwise(
        F.concat(F.array_join(F.transform("apart", piece), ""), tail))
    return marked.select(*[(clean if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(others)])


def query(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _text_of(_ordered(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
