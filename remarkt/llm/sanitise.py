"""Information-theoretic sanitisation of personal data, in DataFrame and SQL functions only.

Patterns find e-mail and IP addresses, cards and phone numbers: the protected entities. Terms beside an entity are
the candidates; they are counted in all texts that hold it, wherever they stand, and in the whole corpus. A term's disclosure of an entity is the share of the entity's information
that it gives, pointwise mutual information over self-information, 1 when it implies the entity. Where it passes the
threshold the term is removed too, in texts that hold the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import staged

#: Kinds in the order in which they are listed; the last is what the corpus adds.
KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

#: A run can only match from its start or from the end of the match before, so no other start is tried; nothing is given back that the next character could not take.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: After LONE is replaced, blanks and hyphens are left only between two digits of a card.
LONE, CARD = r"(?<=[0-9])[ -](?![0-9])", r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Whole words on each side of an entity (within CONTEXT code points) that are candidates, unlike texts that must hold a pair, disclosure from which a term goes.
NEAR, CONTEXT, SUPPORT, DISCLOSURE = 6, 100, 3, 0.9

SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(kind: int, zipped: str) -> Column:
    """Spans of a kind from arrays_zip(parts, matches) of a text: running sums of lengths, 128 matches at a time so that no long array is copied for each."""
    start = "b.pos + length(x.parts)"
    inner = f"""aggregate(slice({zipped}, c * 128 + 1, 128), struct(cast(array() as {SPANS}) as a, if(size(acc) = 0, 0, element_at(acc, -1).pos) as pos),
        (b, x) -> struct(if(x.matches is null, b.a, concat(b.a, array(struct({start} as s, {kind} as k, {start} + length(x.matches) as e, x.matches as v)))) as a,
                         {start} + coalesce(length(x.matches), 0) as pos))"""
    return F.expr(f"flatten(transform(aggregate(sequence(0, (size({zipped}) - 1) div 128), cast(array() as array<struct<a:{SPANS},pos:int>>), (acc, c) -> concat(acc, array({inner}))), x -> x.a))")


def zipped(df: DataFrame, name: str, text: str, pattern: str, when: str) -> DataFrame:
    df = df.withColumn("_parts", F.expr(f"if({when}, split({text}, {quoted(pattern)}, -1), array(''))")).withColumn("_matches", F.expr(f"if({when}, regexp_extract_all({text}, {quoted(pattern)}, 0), cast(array() as array<string>))"))
    return df.withColumn(name, F.arrays_zip(F.col("_parts").alias("parts"), F.col("_matches").alias("matches"))).drop("_parts", "_matches")


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


#: What a match must hold besides its pattern.
IP_OK = "forall(split(x.v, '\\\\.'), p -> length(ltrim('0', p)) <= 3 and coalesce(cast(nullif(ltrim('0', p), '') as bigint), 0) <= 255)"
CARD_OK = (
    f"length({digits('x.v')}) between 12 and 19 and aggregate(sequence(1, 19), 0, (n, i) -> n + case when i > length({digits('x.v')}) then 0 "
    f"else element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(reverse({digits('x.v')}), i, 1) as int) + if(i % 2 = 0, 11, 1)) end) % 10 = 0"
)
PHONE_OK = f"length({digits('x.v')}) between 9 and 15"


def with_spans(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and, added, _spans: all entities by start, then kind."""
    df = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    df = df.withColumn("_carded", F.expr(f"if(_t rlike '[0-9](?:[ -]?[0-9]){{11}}', regexp_replace(_t, {quoted(LONE)}, '\\u0001'), '')"))
    for name, text, pattern, when in (("_z0", "_t", EMAIL, "contains(_t, '@')"), ("_z1", "_t", IP, "_t rlike '[0-9]\\\\.[0-9]'"), ("_z2", "_carded", CARD, "_carded <> ''"), ("_z3", "_t", PHONE, "contains(_t, '+')")):
        df = zipped(df, name, text, pattern, when)
    for kind in range(4):
        df = df.withColumn(f"_z{kind}", found(kind, f"_z{kind}"))
    every = F.concat("_z0", F.expr(f"filter(_z1, x -> {IP_OK})"), F.expr(f"filter(_z2, x -> {CARD_OK})"), F.expr(f"filter(_z3, x -> {PHONE_OK})"))
    return df.withColumn("_spans", F.array_sort(every)).drop("_carded", *(f"_z{k}" for k in range(4)))


#: What names a text: all that is found depends on the text alone. Two hashes and the length, 128 bits and more.
KEY = ("_h", "_g", "_n")


def text_key() -> list[Column]:
    return [F.xxhash64("_t").alias("_h"), F.xxhash64(F.lit(1), F.col("_t")).alias("_g"), F.length("_t").alias("_n")]


def in_chunks(spans: str, base: str, upto: str, body: str) -> str:
    """body for each span x (i: its number, m: its chunk) of a sorted array that isn't empty, in an array.

    Spans go 128 at a time, and p.piece is the part of the text from p.base that these need (from base upto, of the
    chunk m and its number c): a place in the text is counted from its start, so no span counts through all of it.
    """
    return (
        f"flatten(transform(sequence(0, (size({spans}) - 1) div 128), c -> transform(array(slice({spans}, c * 128 + 1, 128)), m -> transform(array({base}), b -> "
        f"transform(array(struct(b as base, substring(_t, b + 1, {upto} - b) as piece)), p -> transform(m, (x, i) -> {body}))[0])[0])[0]))"
    )


def beside(near: int) -> Column:
    """For each entity its name and the words that may be terms among the next whole ones on each side."""
    inner, edge = WORD[:-1], CONTEXT + 1
    before = f"substring(p.piece, greatest(0, x.s - {edge}) - p.base + 1, least(x.s, {edge}))"
    after = f"substring(p.piece, x.e - p.base + 1, {edge})"
    # a word that is cut at the far end is none
    before = f"if(x.s >= {edge}, regexp_replace({before}, {quoted('^' + inner + '+')}, ''), {before})"
    after = f"if(length({after}) = {edge}, regexp_replace({after}, {quoted(inner + '+$')}, ''), {after})"
    words = lambda side: f"filter(split(lower({side}), {quoted(GAP)}), w -> w <> '')"
    terms = f"array_distinct(filter(concat(slice(reverse({words(before)}), 1, {near}), slice({words(after)}, 1, {near})), w -> {MEANT}))"
    body = f"struct(concat(x.k, ':', lower(x.v)) as entity, {terms} as terms)"
    return F.expr(in_chunks("_spans", f"greatest(0, m[0].s - {edge})", f"(array_max(transform(m, y -> y.e)) + {edge})", body))


#: Of words: those that may be terms.
MEANT = r"length(w) >= 3 and not w rlike '[0-9]' and not contains(w, '\uE000')"


def texts_hit(docs: DataFrame) -> DataFrame:
    """Key, text and spans of the rows that hold an entity.

    The row's number keeps the filter above the patterns: pushed below them it would hold them once more, inside a
    lambda even for each 128 spans.
    """
    marked = with_spans(docs.select("text")).withColumn("_at", F.monotonically_increasing_id())
    return marked.where((F.size("_spans") > 0) & (F.col("_at") >= 0)).select(*text_key(), F.struct("_t", "_spans").alias("one"))


def texts_with_entities(docs: DataFrame, near: int) -> DataFrame:
    """One row for each unlike text of docs (text) that holds an entity: its key, copies, text, spans, and for each span the entity and terms beside it."""
    one = texts_hit(docs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("one").alias("one"))
    return staged(one.select(*KEY, "copies", "one.*").withColumn("around", beside(near)), "entities")


def disclosing_terms(docs: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(key, term) of texts that hold an entity which the term discloses. texts: from texts_with_entities.

    A term is a candidate for an entity if any text has it beside that; both its counts are over whole texts. No
    entity's or term's texts are gathered: they stay rows, and joins on a hot one are split by adaptive execution.
    Words meet candidates by term, not by text and entity: a pair that can pass has a term in few more texts than its
    entity, so a term's rows are some times the mentions of its entities, while a text's words times its entities, or
    an entity's texts times its terms, have no such bound.
    """
    near = texts.select(*KEY, "copies", F.explode("around").alias("x")).select(*KEY, "copies", "x.*")
    held = near.select("entity", *KEY, "copies").distinct()
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_e")).where(F.col("texts") >= support)
    named = near.select("entity", F.explode("terms").alias("term")).distinct().join(entities.select("entity", "n_e"), "entity")
    # how many documents of the corpus have each word: summed in the tasks first
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), GAP))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") >= support)
    n = docs.select(F.lit(1)).groupBy().agg(F.count(F.lit(1)).alias("n")).first()[0]
    share = lambda n_te: 1 + F.log(n_te / F.greatest("n_t", n_te)) / F.log(F.lit(float(n)) / F.col("n_e"))
    # those that would pass if as many of the entity's documents as can be had the term
    pairs = staged(named.where(F.col("n_e") < n).join(words, "term").where(share(F.least("n_e", "n_t")) >= disclosure), "pairs")
    own = texts.select(*KEY, "copies", F.explode(F.array_distinct(F.split(F.lower("_t"), GAP))).alias("term"))
    whole = staged(own.join(pairs, "term").join(held.select("entity", *KEY), ["entity", *KEY], "left_semi"), "whole")
    counted = whole.groupBy("entity", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("n_te")).where(F.col("texts") >= support)
    return whole.select(*KEY, "entity", "term").join(counted.where(share(F.col("n_te")) >= disclosure).select("entity", "term"), ["entity", "term"], "left_semi").select(*KEY, "term").distinct()


def merged(spans: str) -> Column:
    """Sorted spans as such that don't overlap, each with the kind of its first."""
    start = "if(size(acc) = 0, struct(cast(array() as array<struct<s:int,k:int,e:int>>) as a, -1 as s, -1 as k, -1 as e), struct(cast(array() as array<struct<s:int,k:int,e:int>>) as a, element_at(acc, -1).s as s, element_at(acc, -1).k as k, element_at(acc, -1).e as e))"
    step = "if(x.s < b.e, struct(b.a as a, b.s as s, b.k as k, greatest(b.e, x.e) as e), struct(if(b.e < 0, b.a, concat(b.a, array(struct(b.s as s, b.k as k, b.e as e)))) as a, x.s as s, x.k as k, x.e as e))"
    rounds = f"aggregate(sequence(0, (size({spans}) - 1) div 128), cast(array() as array<struct<a:array<struct<s:int,k:int,e:int>>,s:int,k:int,e:int>>), (acc, c) -> concat(acc, array(aggregate(slice({spans}, c * 128 + 1, 128), {start}, (b, x) -> {step}))))"
    last = "array(struct(element_at(l, -1).s as s, element_at(l, -1).k as k, element_at(l, -1).e as e))"
    return F.expr(f"transform(array({rounds}), l -> concat(flatten(transform(l, y -> y.a)), {last}))[0]")


def replaced(merged: str, by: str) -> str:
    """The text with by for each span x of an array that isn't empty and of which none overlap."""
    piece = f"concat(substring(p.piece, if(i = 0, p.base, m[i - 1].e) - p.base + 1, x.s - if(i = 0, p.base, m[i - 1].e)), {by})"
    parts = in_chunks(merged, f"if(c = 0, 0, {merged}[c * 128 - 1].e)", "element_at(m, -1).e", piece)
    return f"concat(array_join({parts}, ''), substring(_t, element_at({merged}, -1).e + 1))"


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, _extra) of texts that have terms (key, term): spans of these outside all entities."""
    marked = texts.join(terms.select(*KEY).distinct(), [*KEY], "left_semi").withColumn("_m", merged("_spans"))
    # entities are masked by what no term has, so that words keep their places
    masked = marked.select(*KEY, F.expr(replaced("_m", "repeat('\uE000', x.e - x.s)")).alias("_masked"))
    places = zipped(masked, "_w", "_masked", WORD, "true").select(*KEY, F.explode(found(4, "_w")).alias("x"))
    return places.withColumn("term", F.lower("x.v")).join(terms, [*KEY, "term"], "left_semi").groupBy(*KEY).agg(F.collect_list("x").alias("_extra"))


def sanitised(docs: DataFrame, near: int = NEAR, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs (with a column text) and, added, _t (the text, not null), _spans (entities: start s, kind k, end e, value v, in code points) and _all (with the terms)."""
    texts = texts_with_entities(docs, near)
    extra = term_spans(texts, staged(disclosing_terms(docs, texts, support, disclosure), "terms"))
    none = F.expr(f"cast(array() as {SPANS})")
    known = texts.select(*KEY, "_spans").join(extra, [*KEY], "left").withColumn("_all", F.when(F.col("_extra").isNull(), F.col("_spans")).otherwise(F.array_sort(F.concat("_spans", "_extra")))).drop("_extra")
    keyed = docs.withColumn("_t", F.coalesce("text", F.lit(""))).select("*", *text_key())
    return keyed.join(known, [*KEY], "left").withColumns({c: F.coalesce(c, none) for c in ("_spans", "_all")}).drop(*KEY)


def listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def redacted_text() -> Column:
    """The text of sanitised (with _m, its merged spans) with a label for each span; spans that overlap become one, named by the first."""
    labels = "array(" + ", ".join(f"'{k}'" for k in LABELS) + ")"
    return F.when(F.col("_m").isNull(), F.col("text")).otherwise(F.expr(replaced("_m", f"{labels}[x.k]")))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities and disclosing terms replaced in text; n_chars, if there, is counted anew where the text changed. All other rows, columns and nulls stay as they are.

    Repeated rows and copies of a text change alike; an empty table gives an empty result.
    """
    work = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    marked = sanitised(work).withColumn("_m", F.when(F.size("_all") > 0, merged("_all")))
    found_ = marked.select("row", redacted_text().alias("new"), F.col("_m").isNotNull().alias("hit"))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("hit"), F.length("new").cast("bigint")).otherwise(F.col("row")[c]).alias(c))
        else:
            out.append(F.col("row")[c].alias(c))
    return found_.select(*out)


def personal_data_report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text) the counts of entities, a digest of their spans, and all spans.

    Null and empty texts have none. Copies of a text get the same spans; repeated rows are each answered; other
    columns are not read; an empty table gives an empty result. Whole texts are read; one text's spans are the most a
    task holds at once. The regular expressions take a text's length in time but for domains of thousands of labels.
    """
    df = sanitised(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(_spans, x -> x.k = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(4)]
    return df.select("doc_id", *counts, F.sha2(listed("_spans").cast("binary"), 256).alias("base_sha256"), listed("_all").alias("spans"))
