"""Personal data: pattern spans, and terms that the corpus itself shows to reveal the protected entities.

Entities are the distinct e-mail addresses, IP addresses, card and phone numbers of the corpus. A term that stands near an
entity in several different contexts discloses it as far as its pointwise mutual information with the entity reaches the
entity's own information content. Terms above the threshold are generalised, and removed where they all but name it.
Everything is DataFrame expressions: positions come from the lengths of what a pattern splits off, summed up in two levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import BROADCAST_ROWS, small_join, stored

#: Fixed by the contract, in its order. Written with possessive repeats and without fruitless starts, so that each finds the
#: same matches in linear time and without deep recursion: an e-mail begins where its local part's run begins or the last
#: match ended; a card has 16 digits at least.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text must pass before its pattern runs.
HINTS = {"email": "%@%", "ip": "%.%", "card": "%", "phone": "%+%"}
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
#: Code points on each side of a mention that count as its context; a term, of letters, marks and digits, lies within one.
CONTEXT, TERM = 160, (1, 160)
#: Part of an entity's information that a term must carry to be generalised, and to be removed; contexts that must show it.
DISCLOSES, NAMES, SUPPORT = 0.8, 0.98, 3
#: One document in so many gives the first lower bound of the terms' counts.
ONE_IN = 16
#: Elements of an array that are summed up in one stretch.
STRETCH = 256


def running_total(steps: Column) -> Column:
    """Prefix sums of an array of longs: within stretches, then over the stretches' totals, so arrays of any length are cheap."""
    start = F.array(F.lit(0).cast("long"))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    stretches = F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / STRETCH).cast("int")), lambda c: F.slice(steps, c * STRETCH + 1, STRETCH))
    within = F.transform(stretches, lambda s: F.aggregate(s, start, grow))
    before = F.aggregate(within, start, lambda acc, w: grow(acc, F.element_at(w, -1)))
    shifted = F.zip_with(within, F.slice(before, 1, F.size(within)), lambda w, b: F.transform(F.slice(w, 2, F.size(w) - 1), lambda x: x + b))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(shifted))


def _starts(pieces: Column, hits: Column) -> Column:
    """Where each hit begins, in code points, from what lies between the hits."""
    lengths = F.transform(hits, lambda h: F.char_length(h).cast("long"))
    gaps = F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.char_length(p).cast("long"))
    return running_total(F.zip_with(gaps, F.slice(F.concat(F.array(F.lit(0).cast("long")), lengths), 1, F.size(hits)), lambda g, n: g + n))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))
    worth = lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(places, F.lit(0), lambda acc, i: acc + worth(i) - F.when(worth(i) > 9, 9).otherwise(0))
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(PART),
        "card": F.when(digits.between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False)),
        "phone": digits.between(8, 15),
    }[kind]


def _entity(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def _whole_words(piece: Column, at_edge: Column, after: bool) -> Column:
    """The piece beside a mention, of CONTEXT + 1 code points at most, without words that touch the mention or are cut.

    At the outer end a word is whole where the text itself ends (at_edge, and the piece no longer than CONTEXT); else it is joined
    to another mention or, as the one code point more tells, runs on beyond the context.
    """
    inner, outer = (r"^[\p{L}\p{M}\p{N}]+", r"[\p{L}\p{M}\p{N}]+$") if after else (r"[\p{L}\p{M}\p{N}]+$", r"^[\p{L}\p{M}\p{N}]+")
    own = F.regexp_replace(piece, inner, "")
    return F.when(at_edge & (F.char_length(piece) <= CONTEXT), own).otherwise(F.regexp_replace(own, outer, ""))


def _spans_of(kind: str) -> Column:
    """The kind's spans from its hits, the pieces between them and its starts."""
    hits, gaps = F.col(f"__{kind}"), F.col(f"__{kind}_gaps")
    n = F.size(hits)
    rows = F.arrays_zip(hits.alias("v"), F.col(f"__{kind}_at").alias("at"), F.slice(gaps, 1, n).alias("before"), F.slice(gaps, 2, n).alias("after"))
    rows = F.filter(rows, lambda r: _holds(kind, r["v"]))
    return F.transform(
        rows,
        lambda r: F.struct(
            F.lit(kind).alias("kind"), r["at"].alias("start"), (r["at"] + F.char_length(r["v"])).alias("stop"), _entity(kind, r["v"]).alias("entity"),
            F.substring(r["before"], -CONTEXT, CONTEXT).alias("before"), F.substring(r["after"], 1, CONTEXT).alias("after"),
            _whole_words(F.substring(r["before"], -CONTEXT - 1, CONTEXT + 1), r["at"] == F.char_length(r["before"]), False).alias("words_before"),
            _whole_words(F.substring(r["after"], 1, CONTEXT + 1), r["at"] + F.char_length(r["v"]) + F.char_length(r["after"]) == F.char_length("__text"), True).alias("words_after"),
        ),
    )


def with_base_spans(docs: DataFrame) -> DataFrame:
    """docs with __base: structs (kind, start, stop, entity, before, after, words_before, words_after) of the pattern spans, by kind and start.

    Matches are leftmost and non-overlapping within each kind; those that fail their kind's test are dropped. Starts and stops
    count code points, stop exclusive; before and after are the pieces of text around the match, and
    words_before and words_after the same without words that are cut.
    """
    for kind, pattern in KINDS.items():
        hits = F.regexp_extract_all(F.col("__text"), F.lit(pattern), F.lit(0))
        docs = docs.withColumn(f"__{kind}", F.when(F.col("__text").like(HINTS[kind]), hits).otherwise(F.array().cast("array<string>")))
    for kind, pattern in KINDS.items():
        docs = docs.withColumn(f"__{kind}_gaps", F.when(F.size(f"__{kind}") > 0, F.split("__text", pattern, -1)).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        docs = docs.withColumn(f"__{kind}_at", _starts(F.col(f"__{kind}_gaps"), F.col(f"__{kind}")))
    docs = docs.withColumn("__base", F.concat(*map(_spans_of, KINDS)))
    own = [f"__{kind}{part}" for kind in KINDS for part in ("", "_gaps", "_at")]
    return docs.drop(*own)


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.char_length(w).between(*TERM))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with __text (null as empty) and two hashes that tell different documents apart; repeated rows share them."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"__text": text, "__k1": F.xxhash64("doc_id", text), "__k2": F.xxhash64(text, F.lit("k"), "doc_id")})


def disclosing_terms(docs: DataFrame, discloses: float = DISCLOSES, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(term, carries): terms that disclose an entity, and the share of its information that the worst one gives away;
    and (__k1, __k2, term): which documents hold which terms. Both tables are stored.

    Of N documents df(c) hold the entity c and df(t) the term t; joint(c, t) hold t in a context of c. A term carries
    ln(N joint / (df(c) df(t))) / ln(N / df(c)) of c. Only terms found in `support` different contexts of c are judged:
    copies of one text are one context. All documents count, whole; rows that repeat a document (id and text) count once,
    in N and in every df and joint.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    copies = stored(keyed.groupBy("__k1", "__k2").agg(F.count("*").alias("__n")), "documents")
    n_docs = copies.count()
    repeated = stored(copies.where("__n > 1"), "repeated")
    around = F.concat_ws(" ", F.col("m.before"), F.col("m.after"))
    inner = F.concat_ws(" ", F.col("m.words_before"), F.col("m.words_after"))
    # explode_outer: plain explode would have the whole search run a second time in a filter on the array's size.
    mentions = with_base_spans(keyed).select("__k1", "__k2", F.explode_outer("__base").alias("m")).where("m is not null")
    mentions = stored(mentions.select("__k1", "__k2", "m.entity", F.xxhash64(around).alias("context"), F.array_distinct(_terms(inner)).alias("terms")), "mentions")
    entities = mentions.groupBy("entity").agg(F.count_distinct("__k1", "__k2").alias("df_c"))
    pairs = mentions.select("__k1", "__k2", "entity", "context", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("__k1", "__k2").alias("joint"))
    # A term is in at least as many documents as have it near any entity: what cannot reach the threshold even so is left out.
    near = pairs.groupBy("term").agg(F.count_distinct("__k1", "__k2").alias("df_t"))
    n = F.lit(float(max(n_docs, 1)))
    carries = F.log(n * F.col("joint") / (F.col("df_c") * F.col("df_t"))) / F.log(n / F.col("df_c"))
    joint = joint.where(F.col("contexts") >= support).join(entities, "entity").where(F.col("df_c") < n).join(near, "term")
    joint = stored(joint.where(carries >= discloses).drop("df_t"), "joint")
    # One document in ONE_IN already tells most common words: a term has at least as many in all. What is left is counted in full.
    some = _frequency(keyed.where(F.pmod("__k1", F.lit(ONE_IN)) == 0), joint, repeated)
    joint = stored(joint.join(some, "term", "left").withColumn("df_t", F.coalesce("df_t", F.lit(1.0))).where(carries >= discloses).drop("df_t"), "joint")
    frequency = _frequency(keyed, joint, repeated)
    judged = joint.join(frequency, "term").groupBy("term").agg(F.max(carries).alias("carries"))
    disclosing = stored(judged.where(F.col("carries") >= discloses), "disclosing")
    return disclosing, stored(_held(keyed, disclosing.select("term")).distinct(), "holders")


def _frequency(keyed: DataFrame, joint: DataFrame, repeated: DataFrame) -> DataFrame:
    """term, df_t: in how many documents of keyed each of joint's terms stands. A repeated document's rows share its one count."""
    held = _held(keyed, stored(joint.select("term").distinct(), "terms"))
    rows = small_join(held, repeated, ["__k1", "__k2"], "left", limit=BROADCAST_ROWS // 2)
    return rows.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("__n", F.lit(1)))).alias("df_t"))


def _held(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """__k1, __k2, term: the wanted terms that each document holds, once each."""
    words = keyed.select("__k1", "__k2", F.explode(F.array_distinct(_terms(F.col("__text")))).alias("term"))
    return small_join(words, wanted, ["term"], "left_semi", limit=BROADCAST_ROWS // 4)


def _term_spans(terms: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))


def find_spans(docs: DataFrame, discloses: float = DISCLOSES, names: float = NAMES, support: int = SUPPORT) -> DataFrame:
    """docs with `spans`: structs (kind, start, stop, action) by kind (email, ip, card, phone, term) and start.

    Pattern spans are generalised; a term that discloses an entity is generalised wherever it stands outside pattern spans, in
    any document, or removed if it carries `names` of the entity or more. Null and empty texts have no spans; repeated rows
    get the same spans and change no others; an empty table gives no rows. All rows and columns of docs stay, but a column
    `spans` is replaced.
    """
    disclosing, holders = disclosing_terms(docs, discloses, support)
    held = holders.join(disclosing, "term").select("__k1", "__k2", F.when(F.col("carries") >= names, F.lit("remove")).otherwise(F.lit("generalise")).alias("action"), "term")
    held = stored(held.distinct(), "held")
    lists = held.groupBy("__k1", "__k2").agg(F.collect_set("term").alias("__terms"), F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("__removed"))
    keyed = with_base_spans(_keyed(docs))
    few = held.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    rows = keyed.join(F.broadcast(lists) if few else lists, ["__k1", "__k2"], "left")
    pattern = _term_spans(F.col("__terms"))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__pattern", F.when(F.col("__terms").isNotNull(), pattern))
    rows = rows.withColumn("__hits", F.when(F.col("__pattern").isNotNull(), F.regexp_extract_all(F.col("__text"), F.col("__pattern"), F.lit(0))).otherwise(none))
    rows = rows.withColumn("__gaps", F.when(F.size("__hits") > 0, F.split(F.col("__text"), F.col("__pattern"), -1)).otherwise(none))
    rows = rows.withColumn("__at", _starts(F.col("__gaps"), F.col("__hits")))
    found = F.transform(
        F.arrays_zip(F.col("__hits").alias("v"), F.col("__at").alias("at")),
        lambda r: F.struct(F.lit("term").alias("kind"), r["at"].alias("start"), (r["at"] + F.char_length(r["v"])).alias("stop"), F.when(F.array_contains(F.col("__removed"), F.lower(r["v"])), F.lit("remove")).otherwise(F.lit("generalise")).alias("action")),
    )
    free = F.filter(found, lambda s: ~F.exists(F.col("__base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    base = F.transform("__base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop"), F.lit("generalise").alias("action")))
    own = ["__k1", "__k2", "__text", "__base", "__terms", "__removed", "__pattern", "__hits", "__gaps", "__at"]
    return rows.withColumn("spans", F.concat(base, free)).drop(*own)


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """find_spans() with `sanitised`: the text with each span replaced by its kind in brackets, or cut out.

    Where spans of different kinds overlap, the first one stands and what overlaps it is skipped. Null texts stay null. Columns
    `spans` and `sanitised` of docs are replaced.
    """
    found = find_spans(docs, **thresholds)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["action"].alias("action"))))
    mark = lambda s: F.when(s["action"] == "remove", F.lit("")).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    upto = lambda acc, stop: F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (stop - acc["at"]).cast("int"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], upto(acc, s["start"]), mark(s)).alias("out"), s["stop"].alias("at"))).otherwise(acc)
    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], upto(acc, F.char_length("text").cast("long"))))
    return found.withColumn("sanitised", whole)


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
