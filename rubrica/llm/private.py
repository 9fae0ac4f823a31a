"""Personal data: fixed patterns, and words that give a protected value away, by co-occurrence.

Base findings are e-mail addresses, IP numbers, card and phone numbers. Each distinct value is a protected entity, and so is
the domain of an e-mail address. Over the distinct texts of the corpus, PMI(entity; word) = ln(p(word | entity) / p(word))
says how much of the entity's information IC = -ln(n(entity) / N) a word discloses. One text is no evidence, since there all
its words go with the value, and neither are copies of it with small changes: texts of an entity that share a MinHash
of their five-word shingles are one family, and an entity and a word beside it are counted by families. A word must stand
in ``LEAST_TEXTS`` families of the entity, and its PMI is taken at the
lower end of a confidence interval, with the Wilson bounds of p(word | entity) from below and of p(word) from above. From
``generalise`` times IC on the word is generalised to its shape, from ``remove`` times IC on it is removed, in every text
where it stands: a text that reveals an entity without naming it is the case this is for. Only built-in expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rubrica.llm.base import SHINGLE_WORDS, bare, stored, text_key, unwrapped, wrapped
from rubrica.llm.components import components

# Fixed: the base patterns, with possessive groups so that no text makes them backtrack. A local
# part or a number begins where no character of its class stands before it, or where the match
# before ended.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
_WORD_CHAR = r"[^\x20\x09-\x0D]"
_KEY = ["_k", "_z", "_h"]
_STEP = 64
GENERALISE = 0.7
REMOVE = 0.9
LEAST_TEXTS = 3
# Texts of similarity s are one family with probability 1 - (1 - s) ** MINIMA: .996 at one half.
MINIMA = 8
# One-sided confidence of 95 % for each bound.
DEVIATIONS = 1.645
BROADCAST_WORDS = 200_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, v: s + v)


def _with_matches(df: DataFrame, kind: str, pattern: Column) -> DataFrame:
    """Adds ``_m_<kind>``: (start, end, text) of every leftmost match that does not overlap another.

    Offsets count code points. They are sums over gaps and matches, over blocks of 64 first, so that
    a text with very many matches stays near linear.
    """
    gaps, found = F.split(F.col("text"), pattern), F.regexp_extract_all("text", pattern, F.lit(0))
    df = df.withColumns({"_gaps": gaps, "_found": found})
    size = F.zip_with(
        "_gaps", "_found", lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))
    )
    df = df.withColumn("_sizes", size)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / _STEP).cast("int"))
    totals = F.transform(blocks, lambda b: _sum(F.slice("_sizes", b * _STEP + 1, F.lit(_STEP))))
    df = df.withColumn("_totals", totals)
    before = F.aggregate(
        "_totals", F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t))
    )
    df = df.withColumn("_before", before)

    def match(m: Column, i: Column) -> Column:
        block = F.floor(i / _STEP).cast("int")
        start = (
            F.get("_before", block)
            + _sum(F.slice("_sizes", block * _STEP + 1, i - block * _STEP))
            + F.char_length(F.get("_gaps", i))
        )
        return F.struct(start.alias("s"), (start + F.char_length(m)).alias("e"), m.alias("m"))

    done = df.withColumn(f"_m_{kind}", F.transform("_found", match))
    return done.drop("_gaps", "_found", "_sizes", "_totals", "_before")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits, at most 19 here, pass the Luhn sum."""
    backward = F.reverse(_digits(m))

    def value(i: Column) -> Column:
        d = F.substring(backward, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(backward)))
    return _sum(F.transform(places, value)) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        fits = F.forall(
            parts,
            lambda p: F.when(F.char_length(p) > 3, F.lit(False)).otherwise(
                F.coalesce(p.try_cast("int"), F.lit(0)) <= 255
            ),
        )
        return fits
    n = F.char_length(_digits(m))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(m)).otherwise(F.lit(False))
    return n.between(9, 15)


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted (start, order, end, kind) spans."""
    each = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(each, ",")


def _kept(kind: str, order: int) -> Column:
    """The findings of a kind that pass its test, ready to be sorted by start, then kind."""
    return F.transform(
        F.filter(f"_m_{kind}", lambda x: _passes(kind, x["m"])),
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"),
            F.lit(kind).alias("kind"), x["m"].alias("m"),
        ),
    )


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``_base``: sorted (s, o, e, kind, m) of every base finding in ``text`` (never NULL)."""
    df = docs
    for kind in KINDS:
        df = _with_matches(df, kind, F.lit(PATTERNS[kind]))
    kept = [_kept(kind, o) for o, kind in enumerate(KINDS)]
    return df.withColumn("_base", F.sort_array(F.concat(*kept))).drop(*[f"_m_{k}" for k in KINDS])


def _entity(kind: Column, m: Column) -> Column:
    """Name of a protected value: its kind and its lower-cased text, numbers by their digits."""
    plain = F.when(kind.isin("card", "phone"), _digits(m)).otherwise(F.lower(m))
    return F.xxhash64(kind, plain)


def _words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _entities(based: DataFrame) -> DataFrame:
    """Distinct (text, entity): _h, _e, _f (the text's family) and n_e, of entities in ``LEAST_TEXTS`` families or more."""
    found = based.select("_h", F.explode_outer("_base").alias("x")).filter("x IS NOT NULL")
    kind, m = F.col("x.kind"), F.col("x.m")
    domain = F.when(kind == "email", F.xxhash64(F.lit("domain"), F.substring_index(F.lower(m), "@", -1)))
    names = F.filter(F.array(_entity(kind, m), domain), lambda e: e.isNotNull())
    held = found.select("_h", F.explode(names).alias("_e")).distinct()
    texts = held.groupBy("_e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    held = stored(held.join(texts.select("_e"), "_e"), "shared-entities")
    families = _families(based.join(held.select("_h").distinct(), "_h", "left_semi"))
    held = held.join(families, "_h")
    counts = held.groupBy("_e").agg(F.count_distinct("_f").alias("n_e")).filter(F.col("n_e") >= LEAST_TEXTS)
    return held.join(counts, "_e")


def _families(texts: DataFrame) -> DataFrame:
    """_h and _f of each text: texts that share any of ``MINIMA`` MinHashes are one family, also over others."""
    texts = texts.select("_h", _words("text").alias("_w")).dropDuplicates(["_h"])
    last = F.greatest(F.size("_w") - SHINGLE_WORDS + 1, F.lit(1))
    shingles = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_w", i, SHINGLE_WORDS)))
    texts = stored(texts.select("_h", shingles.alias("_s")), "shingles")
    minima = [F.struct(F.lit(k).alias("k"), F.array_min(F.transform("_s", lambda x, k=k: F.xxhash64(x, F.lit(k)))).alias("m")) for k in range(MINIMA)]
    rows = stored(texts.select("_h", F.inline(F.array(*minima))), "minima")
    heads = rows.groupBy("k", "m").agg(F.min("_h").alias("a"), F.max("_h").alias("z")).filter("a <> z")
    roots = components(rows.join(heads.drop("z"), ["k", "m"]).select("a", F.col("_h").alias("b")))
    named = texts.select("_h").join(roots.withColumnRenamed("node", "_h"), "_h", "left")
    return named.select("_h", F.coalesce("root", "_h").alias("_f"))


def _text_words(based: DataFrame) -> DataFrame:
    """Distinct (text, word) over whole texts, without words that a base finding touches: _h, _w, _t."""
    texts = based.select("_h", "text", "_base").dropDuplicates(["_h"])
    # Findings may overlap: each gap begins where all before it have ended.
    ends = F.aggregate(
        "_base", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.greatest(F.element_at(s, -1), x["e"])))
    )
    texts = texts.withColumn("_ends", ends)

    def gap(e: Column, i: Column) -> Column:
        upto = F.coalesce(F.get("_base", i)["s"], F.char_length("text"))
        piece = F.substring("text", e + 1, F.greatest(F.lit(0), upto - e))
        tail = F.regexp_replace(piece, rf"(?<!{_WORD_CHAR}){_WORD_CHAR}++\z", "")
        piece = F.when(i < F.size("_base"), tail).otherwise(piece)
        return F.when(i > 0, F.regexp_replace(piece, rf"^{_WORD_CHAR}++", "")).otherwise(piece)

    words = F.array_distinct(_words(F.array_join(F.transform("_ends", gap), " ")))
    pairs = texts.select("_h", F.explode_outer(words).alias("_w")).filter("_w IS NOT NULL")
    return pairs.withColumn("_t", F.xxhash64("_w"))


def _word_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """In how many distinct texts each wanted word stands: _t, n_t.

    A text of c copies counts 1/c in each, so that no word has to be moved to tell copies apart.
    A broadcast of the wanted words is used up to ``BROADCAST_WORDS`` of them, a shuffle beyond; so for
    the texts with copies.
    """
    copies = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    copies = stored(copies, "copied-texts")
    few = copies.count() <= BROADCAST_WORDS
    small = wanted.count() <= BROADCAST_WORDS
    hashes = F.array_distinct(F.transform(_words("text"), lambda w: F.xxhash64(w)))
    each = rows.select("_h", "text").join(F.broadcast(copies) if few else copies, "_h", "left")
    each = each.select(F.coalesce("_c", F.lit(1)).alias("_c"), F.explode_outer(hashes).alias("_t"))
    hits = each.join(F.broadcast(wanted) if small else wanted, "_t", "left_semi")
    return hits.groupBy("_t").agg(F.round(F.sum(1.0 / F.col("_c"))).cast("bigint").alias("n_t"))


def _wilson(k: Column, n: Column, side: int) -> Column:
    """The lower (side -1) or upper (1) confidence bound of a share of k in n."""
    z2 = DEVIATIONS * DEVIATIONS
    spread = F.sqrt(k * (n - k) / n + z2 / 4.0)
    return (k + z2 / 2.0 + side * DEVIATIONS * spread) / (n + z2)


def share_disclosed(n_et: Column, n_e: Column, n_t: Column, n: Column) -> Column:
    """The part of an entity's information that a word surely discloses; NULL where the entity has none.

    The entity stands in n_e texts, the word in n_t, both together in n_et, of n texts in all.
    """
    pmi = F.log(_wilson(n_et, n_e, -1) / _wilson(n_t, n, 1))
    return pmi / F.nullif(F.log(n / n_e), F.lit(0.0))


def disclosing(
    rows: DataFrame, based: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """Words that disclose an entity: _t (hash), _w, level (1 generalise, 2 remove).

    ``rows`` are all documents, ``based`` those with findings. Everything is counted by distinct
    text, so copies do not make a word look telling. Words too common to reach the threshold with any entity are left out
    before words and entities of a text are brought together, and only words that stand beside an entity in enough families
    are counted over the corpus.
    """
    held = stored(_entities(based), "entities")
    texts = based.join(held.select("_h").distinct(), "_h", "left_semi")
    words = stored(_text_words(texts), "text-words")
    total = rows.select("_h").distinct().agg(F.count(F.lit(1)).cast("double").alias("n")).first()["n"]
    n = F.lit(total)
    # Texts with an entity alone bound n_t from below: words of one of them, and words too common, go at once.
    most = held.agg(F.coalesce(F.max("n_e"), F.lit(1)).cast("double")).scalar()
    families = held.select("_h", "_f").distinct()
    inside = words.join(families, "_h").groupBy("_t").agg(F.count_distinct("_f").alias("n_held"))
    can = (F.col("n_held") >= LEAST_TEXTS) & (F.log(n / F.col("n_held")) >= generalise * F.log(n / most))
    near = words.join(inside.filter(can), "_t").join(held, "_h")
    joint = near.groupBy("_e", "_t").agg(
        F.count_distinct("_f").alias("n_et"), F.min("n_e").alias("n_e"), F.min("_w").alias("_w")
    )
    joint = stored(joint.filter(F.col("n_et") >= LEAST_TEXTS), "joint")
    joint = joint.join(_word_counts(rows, stored(joint.select("_t").distinct(), "joint-words")), "_t")
    share = share_disclosed(F.col("n_et"), F.col("n_e"), F.col("n_t"), n)
    level = F.when(share >= remove, 2).when(share >= generalise, 1)
    told = joint.select("_t", "_w", level.alias("level"))
    return told.filter("level IS NOT NULL").groupBy("_t").agg(F.min("_w").alias("_w"), F.max("level").alias("level"))


def _marked(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Per distinct text that holds one of the words ``told``: _h, _general and _removed, its words by level."""
    small = told.count() <= BROADCAST_WORDS
    hashes = F.array_distinct(F.transform(_words("text"), lambda w: F.xxhash64(w)))
    each = rows.select("_h", F.explode_outer(hashes).alias("_t"))
    hits = each.join(F.broadcast(told) if small else told, "_t")
    return hits.groupBy("_h").agg(
        F.sort_array(F.collect_set(F.when(F.col("level") == 1, F.col("_w")))).alias("_general"),
        F.sort_array(F.collect_set(F.when(F.col("level") == 2, F.col("_w")))).alias("_removed"),
    )


def _escaped(w: Column) -> Column:
    return F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1")


def _pattern(words: str) -> Column:
    """Whole words of a list, in any case; a pattern that never matches for no list."""
    listed = F.array_join(F.transform(words, _escaped), "|")
    whole = F.concat(
        F.lit(rf"(?iu)(?<!{_WORD_CHAR})(?:"), listed, F.lit(rf")(?!{_WORD_CHAR})")
    )
    return F.when(F.size(words) > 0, whole).otherwise(F.lit(r"(?!)"))


def _telling(kind: str, order: int) -> Column:
    """Spans of words that disclose, without those that touch a base finding."""
    free = F.filter(
        f"_m_{kind}", lambda x: ~F.exists("_base", lambda b: (x["s"] < b["e"]) & (b["s"] < x["e"]))
    )
    return F.transform(
        free,
        lambda x: F.struct(
            x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"),
            F.lit(kind).alias("kind"), x["m"].alias("m"),
        ),
    )


def find_private(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Findings of every document: doc_id, _k, _z, _h (its key), _base and _all, sorted spans
    (s, o, e, kind, m) by code points; kinds are the base ones, ``general`` and ``removed``.

    A NULL text counts as empty and has no findings. Repeated rows get the same findings each and are
    counted once. Words that disclose are marked wherever they stand, but for places that touch a base finding.
    """
    rows = bare(docs).withColumns(
        {"_k": F.coalesce("doc_id", F.lit(0)), "_z": F.col("doc_id").isNull(), "_h": text_key()}
    )
    found = with_base(rows).withColumn("text", F.when(F.size("_base") > 0, F.col("text")))
    found = stored(found.select("doc_id", *_KEY, "text", "_base"), "findings")
    told = stored(disclosing(rows, found.filter("text IS NOT NULL"), generalise, remove), "disclosing")
    found = found.drop("text")
    if not told.head(1):
        return found.withColumn("_all", F.col("_base"))
    lists = stored(_marked(rows, told), "marked")
    small = lists.agg(F.sum(F.size("_general") + F.size("_removed"))).first()[0] or 0
    lists = F.broadcast(lists) if small <= BROADCAST_WORDS else lists
    told = rows.select(*_KEY, "text").join(lists, "_h").dropDuplicates(_KEY)
    told = told.join(found.select(*_KEY, "_base").dropDuplicates(_KEY), _KEY)
    told = _with_matches(told, "general", _pattern("_general"))
    told = _with_matches(told, "removed", _pattern("_removed"))
    spans = F.concat("_base", _telling("general", len(KINDS)), _telling("removed", len(KINDS) + 1))
    told = told.select(*_KEY, F.sort_array(spans).alias("_more"))
    done = found.join(told, _KEY, "left")
    return done.withColumn("_all", F.coalesce("_more", "_base")).drop("_more")


def private_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_told (words marked)."""
    found = find_private(docs)

    def n(kind: str) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"),
        (F.size("_all") - F.size("_base")).cast("bigint").alias("n_told"),
    )


def _shape(x: Column) -> Column:
    word = F.when(x["m"].rlike(r"^\p{Lu}"), "[name]").otherwise("[word]")
    return F.when(x["kind"] == "general", word).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by its kind, or its shape if generalised.

    Of overlapping findings the first stands for all. NULL texts stay NULL, texts without findings
    come back byte for byte.
    """
    marks = find_private(docs, **options).filter(F.size("_all") > 0)
    marks = marks.select(*_KEY, F.col("_all").alias("_spans")).dropDuplicates(_KEY)
    keys = [
        F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_z"),
        text_key(F.coalesce("text", F.lit(""))).alias("_h"),
    ]
    rows = wrapped(docs, F.col("text"), *keys).join(marks, _KEY, "left")
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring("text", acc["end"] + 1, x["s"] - acc["end"])
        return F.when(x["s"] < acc["end"], F.struct(
            F.greatest(acc["end"], x["e"]).alias("end"), acc["parts"].alias("parts")
        )).otherwise(F.struct(
            x["e"].alias("end"), F.concat(acc["parts"], F.array(gap, _shape(x))).alias("parts")
        ))

    rows = rows.withColumn("_cut", F.aggregate("_spans", start, step))
    tail = F.substring("text", F.col("_cut.end") + 1, F.lit(2**31 - 1))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join("_cut.parts", ""), tail)
    )
    return unwrapped(rows, docs.columns, text)
