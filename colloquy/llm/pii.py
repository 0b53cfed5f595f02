"""Personal data: base patterns, and information-theoretic sanitisation, in DataFrame functions only.

The base patterns give the protected entities: the distinct values of e-mail
addresses, network addresses, card and phone numbers. Terms are runs of letters
and digits outside all base spans. Over the whole corpus and whole texts, n(t, e)
counts the documents that have both, n(e) and n(t) those that have one, N all. A
term reveals

    PMI(t; e) / IC(e),  PMI = log(n(t, e) N / (n(t) n(e))),  IC(e) = log(N / n(e)),

of the entity: 1 if the entity always comes with the term. A term with a share of
``GENERALISE`` or more is replaced by a general word wherever it stands, in
documents that don't mention the entity too; of ``REMOVE`` or more, removed.

Evidence: ``SUPPORT`` joint documents; that the term is a part of the address
itself (``smith`` of ``j.smith@...``) counts as two of them, so that entities of a
single document have terms as well. A word that merely stands once beside an
entity that stands once is no evidence: every rare word or typing error would go.

Work per text is linear, up to ten million matches: positions are running sums over
blocks of 256, and pieces are cut from an encoding of fixed width. Entities that stand in
the same documents have the same counts and are counted as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, packed, small, unpacked

#: Kinds in their order, with their patterns. Possessive forms of the contract's patterns: they match
#: the same and neither recurse nor go back over long runs (a run of characters is entered once, at its start).
#: A card's run of digits is matched only if it is whole and has 12 to 19 of them; others would be dropped.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9
#: A term; what a part of an address counts for; how long such a part must be.
TERM, OWN, OWN_LENGTH = r"[\p{L}\p{M}\p{N}]{2,}+", 2, 3
#: What takes the place of a term: by what it is made of.
GENERAL = {r"^\p{N}+$": "[NUMBER]", r"\p{N}": "[CODE]", "": "[TERM]"}
#: Items of a block of a running sum; telling terms of a text that are looked for by name.
_BLOCK, _MANY = 256, 200
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def running(values: str, op: Callable[[str, str], str]) -> str:
    """Running folds of an array<int> with one item at least by an associative ``op`` (0 is neutral): plainly within blocks, then over the blocks' last values."""

    def plain(v: str) -> str:
        now = op("acc.at", "nxt")
        return f"aggregate({v}, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, nxt) -> named_struct('at', {now}, 'out', concat(acc.out, array({now}))), acc -> acc.out)"

    blocks = f"transform(sequence(0, cast(floor((size(vals) - 1) / {_BLOCK}) as int)), blk -> {plain(f'slice(vals, blk * {_BLOCK} + 1, {_BLOCK})')})"
    late = f"transform(one, val -> {op('get(tops, nth - 1)', 'val')})"
    whole = f"flatten(transform(blks, (one, nth) -> if(nth = 0, one, {late})))"
    return let(values, "vals", let(blocks, "blks", let(plain("transform(blks, one -> element_at(one, -1))"), "tops", whole)))


def _plus(a: str, b: str) -> str:
    return f"({a} + {b})"


def _greatest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _holds(kind: str, m: str) -> str:
    """Whether a match counts: parts of an address at most 255, numbers of digits, Luhn's check."""
    digits = rf"regexp_replace({m}, r'[^0-9]++', '')"
    if kind == "ip":
        return rf"{m} rlike r'^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]|)(?:\.|$)){{4}}$'"
    if kind == "card":
        doubled = "transform(split(reverse(digits), ''), (d, i) -> if(i % 2 = 0, cast(d as int), get(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(d as int))))"
        return let(digits, "digits", f"if(length(digits) between 12 and 19, aggregate({doubled}, 0, (a, d) -> a + coalesce(d, 0)) % 10 = 0, false)")
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def positions(text: str, pattern: str) -> str:
    """array<struct<start, end, value>> of the matches of a pattern (SQL), leftmost first, without overlaps, in code points."""
    parts = f"transform(split({text}, {pattern}, -1), (g, i) -> named_struct('g', char_length(g), 'm', get(found, i)))"
    ends = running("transform(parts, x -> x.g + coalesce(char_length(x.m), 0))", _plus)
    at = "filter(transform(parts, (x, i) -> named_struct('start', get(ends, i) - char_length(x.m), 'end', get(ends, i), 'value', x.m)), x -> x.value is not null)"
    return let(f"regexp_extract_all({text}, {pattern}, 0)", "found", let(parts, "parts", let(ends, "ends", at)))


def _found(text: str, kind: str) -> str:
    """array<struct<start, kind, end, value>> of a kind's spans."""
    kept = f"filter({positions(text, f"r'{PATTERNS[kind]}'")}, s -> {_holds(kind, 's.value')})"
    shaped = f"transform({kept}, s -> named_struct('start', s.start, 'kind', {KINDS.index(kind)}, 'end', s.end, 'value', s.value))"
    return f"if({text} rlike r'{NEEDS[kind]}', {shaped}, cast(array() as {_SPANS}))"


def _listed(spans: str) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', get(array({names}), s.kind), cast(s.start as string), cast(s.end as string))), ',')"


def base_spans(text: str) -> str:
    """array<struct<start, kind, end, value>> of the base kinds in the order of start, then kind."""
    return f"array_sort(concat({', '.join(_found(text, k) for k in PATTERNS)}))"


def pieces(text: str, spans: str) -> str:
    """array<struct<lo, text, kind>>: what stands between spans (sorted), each with the kind of the span that follows it (null at the end).

    Of overlapping spans the one that starts first decides; what the others
    cover beyond it is no piece either.
    """
    last = f"named_struct('start', char_length({text}), 'kind', cast(null as int), 'end', char_length({text}), 'value', cast(null as string))"
    # four bytes a code point: cutting does not read what stands before. The blank keeps a leading byte order mark a character
    part = "substring(decode(concat(X'00000020', substring(wide, lo * 4 + 1, (hi - lo) * 4)), 'UTF-32'), 2)".replace("lo", "x.lo").replace("hi", "x.hi")
    free = "filter(transform(all, (x, i) -> named_struct('lo', if(i = 0, 0, get(reach, i - 1)), 'hi', x.start, 'kind', x.kind)), x -> x.hi >= x.lo)"
    cut = f"transform({free}, x -> named_struct('lo', x.lo, 'text', {part}, 'kind', x.kind))"
    several = let(f"concat({spans}, array({last}))", "all", let(running("transform(all, x -> x.end)", _greatest), "reach", let(f"encode({text}, 'UTF-32')", "wide", cut)))
    return f"if(size({spans}) > 0, {several}, array(named_struct('lo', 0, 'text', {text}, 'kind', cast(null as int))))"


#: The distinct entities of ``spans``; the values of its e-mail addresses.
_ENTITIES = "array_distinct(transform(spans, s -> concat_ws(':', cast(s.kind as string), s.value)))"
_ADDRESSES = "array_distinct(transform(filter(spans, s -> s.kind = 0), s -> s.value))"


def _terms(text: str) -> str:
    """Distinct terms of a text, in lower case."""
    return f"array_distinct(regexp_extract_all(lower({text}), r'{TERM}', 0))"


def _own(value: str) -> str:
    """Terms that are parts of an address."""
    return f"filter({_terms(value)}, t -> char_length(t) >= {OWN_LENGTH})"


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("id0"), F.xxhash64(doc_id.isNull(), text).alias("h")]


def _profiles(some: DataFrame, n_all: int, scratch: Scratch) -> DataFrame:
    """(row, profile, n_e): the entities of ``SUPPORT`` documents or more that each row names; entities of the same documents are one profile."""
    named = some.select("row", F.explode(F.expr(_ENTITIES)).alias("entity"))
    sums = [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(k), "row"), 34)).alias(f"s{k}") for k in range(3)]  # 90 bits that tell sets of documents apart
    sets = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *sums).where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < n_all))
    first = scratch.table(sets.groupBy("n_e", "s0", "s1", "s2").agg(F.min("entity").alias("entity")).select("entity", "n_e"), "profiles", "snappy")
    return named.join(small(first), "entity").select("row", F.col("entity").alias("profile"), "n_e")


def infer(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, verdicts): found has doc_id, id0, h, spans for every row; verdicts has id0, h and ``said``, term -> what takes its place, where a telling term stands.

    (id0, h), the id and a hash of the text, stands for a row; repeated rows
    have the same spans. Null texts are empty and have none. Counts are over all
    rows of ``docs`` and whole texts, repeated rows as often as they occur.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", *_keys(F.col("doc_id"), F.col("t")), "t")
    between = f"array_join(transform({pieces('t', 'spans')}, p -> p.text), '\\n')"
    spanned = rows.withColumn("spans", F.expr(base_spans("t"))).withColumn("terms", F.when(F.size("spans") > 0, F.expr(_terms(between))))
    own = F.expr(f"flatten(transform({_ADDRESSES}, v -> {_own('v')}))")
    # numbered once, as written: each row counts, repeated ones too
    found = scratch.table(spanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", "id0", "h", "spans", "terms", F.when(F.size("spans") > 0, F.array_intersect("terms", own)).alias("own")), "found", "snappy")
    n_all, some = found.count(), found.where("size(spans) > 0")
    none = found.limit(0).select("id0", "h", F.create_map().cast("map<string,string>").alias("said"))
    known = scratch.table(_profiles(some, n_all, scratch), "known", "snappy")
    # what is a part of an address beside it: the address may stand in this document only
    having = some.where("size(own) > 0").select("row", "spans", "own")
    beside = having.select("row", F.explode(F.expr(_ADDRESSES)).alias("value")).select("row", F.concat(F.lit("0:"), F.col("value")).alias("entity"), F.explode(F.expr(_own("value"))).alias("term"))
    beside = scratch.table(beside.join(having.select("row", F.explode("own").alias("term")), ["row", "term"]).groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te")), "beside", "snappy")
    most = known.agg(F.max("n_e")).first()[0]
    if most is None and beside.isEmpty():
        scratch.drop(known, beside)
        return found, none
    n = float(n_all)
    share = lambda n_t: F.log(F.col("n_te") * F.lit(n) / (n_t * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
    # n(t) is at least the number of documents with spans that have t, and n(t, e) is n(e) at most: what even then tells too little goes before pairs are made
    n_some = some.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_some"))
    n_some = scratch.table(n_some, "some", "snappy")
    rare = n_some.where(F.col("n_some") <= F.lit(_most(n, most or 1) * (1 + 1e-9)))
    inside = some.where(F.lit(most is not None)).select("row", F.explode("terms").alias("term")).join(small(rare), "term")
    fits = F.col("n_some") <= F.pow(F.lit(n), F.lit(1 - GENERALISE)) * F.pow(F.col("n_e"), F.lit(GENERALISE)) * (1 + 1e-9)
    joint = inside.join(known, "row").where(fits).groupBy("term", "profile", "n_e").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= SUPPORT).select("term", "n_e", "n_te")
    n_own = some.where("size(own) > 0").select(F.explode(F.expr(_ENTITIES)).alias("entity"))
    n_own = some.select(F.explode(F.expr(_ENTITIES)).alias("entity")).join(small(n_own.distinct()), "entity", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    alone = beside.where(F.col("n_te") >= SUPPORT - OWN).join(n_own, "entity").where(F.col("n_e") < n_all).select("term", "n_e", "n_te")
    # of a term's entities only the one that it tells most of counts: that with the largest share, whatever n(t) turns out to be at least n_some
    pairs = scratch.table(joint.unionByName(alone).distinct().join(n_some, "term").where(share(F.col("n_some")) >= GENERALISE - 1e-9), "pairs", "snappy")
    wanted = small(pairs.select("term").distinct())
    # runs of a single character are in here too, but no term is
    runs = F.expr(r"array_distinct(split(lower(t), r'[^\p{L}\p{M}\p{N}]++'))").alias("terms")
    plain = rows.join(small(some.select("id0", "h").distinct()), ["id0", "h"], "left_anti").select("id0", "h", runs)
    every = some.select("id0", "h", "terms").unionByName(plain).select("id0", "h", F.explode("terms").alias("term"))
    at = scratch.table(every.join(wanted, "term", "left_semi"), "at", "snappy")
    n_t = at.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    best = pairs.join(n_t, "term").groupBy("term").agg(F.max(share(F.col("n_t"))).alias("share")).where(F.col("share") >= GENERALISE)
    telling = scratch.table(best.select("term", F.when(F.col("share") >= REMOVE, F.lit("")).otherwise(_general(F.col("term"))).alias("value")), "telling", "snappy")
    said = at.join(small(telling), "term").groupBy("id0", "h").agg(F.map_from_entries(F.collect_set(F.struct("term", "value"))).alias("said"))
    verdicts = scratch.table(said, "verdicts", "snappy")
    scratch.drop(known, beside, n_some, pairs, at, telling)
    return found, verdicts


def _most(n_all: float, n_e: float) -> float:
    """The most documents that a term may be in if it is to tell of an entity of ``n_e``."""
    return n_all ** (1 - GENERALISE) * n_e**GENERALISE


def _general(term: Column) -> Column:
    out = F.lit(GENERAL[""])
    for pattern, word in reversed([x for x in GENERAL.items() if x[0]]):
        out = F.when(term.rlike(pattern), F.lit(word)).otherwise(out)
    return out


def _wanted(text: str, said: str) -> str:
    """A pattern that finds the telling terms of a text, and perhaps others: those terms as whole runs, in any case.

    If there are many, or a capital whose small form is longer, any term.
    """
    mark = r"[\p{L}\p{M}\p{N}]"
    own = f"concat(r'(?iu)(?<!{mark})(?:', array_join(map_keys({said}), '|'), r')(?!{mark})')"
    return f"if(size({said}) > {_MANY} or instr({text}, '\u0130') > 0, r'{TERM}', {own})"


def _term_spans(text: str, spans: str, said: str) -> str:
    """The spans of telling terms, outside ``spans``."""
    kept = f"filter({positions('p.text', 'wanted')}, t -> map_contains_key({said}, lower(t.value)))"
    return f"flatten(transform({pieces(text, spans)}, p -> transform({kept}, t -> named_struct('start', t.start + p.lo, 'kind', {len(PATTERNS)}, 'end', t.end + p.lo, 'value', lower(t.value)))))"


def _counts() -> list[Column]:
    return [F.expr(f"size(filter(spans, s -> s.kind = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term: a row for each row of ``docs``.

    Null texts are empty; repeated rows give repeated rows; other columns are
    not looked at; an empty table gives an empty table.
    """
    found, verdicts = infer(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).select(*_keys(F.col("i"), F.col("t")), "t")
    telling = rows.join(small(verdicts), ["id0", "h"]).dropDuplicates(["id0", "h"]).join(found.select("id0", "h", "spans").dropDuplicates(["id0", "h"]), ["id0", "h"])
    added = telling.withColumn("wanted", F.expr(_wanted("t", "said"))).select("id0", "h", F.expr(_term_spans("t", "spans", "said")).alias("added"))
    out = found.select("doc_id", "id0", "h", "spans").join(added, ["id0", "h"], "left").withColumn("added", F.coalesce("added", F.array().cast(_SPANS)))
    base = F.sha2(F.expr(_listed("spans")), 256).alias("base_sha256")
    return out.select("doc_id", *_counts(), base, F.expr(_listed("concat(spans, added)")).alias("all_spans"), F.size("added").cast("long").alias("n_term")).withColumnRenamed("all_spans", "spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``) rewritten: base spans become [EMAIL], [IP], [CARD], [PHONE]; telling terms go or become a general word wherever they stand.

    Where spans overlap, the one that starts first decides, and what the others
    cover beyond it goes too. Texts without spans and telling terms, null ones
    included, stay as they are; repeated rows stay repeated; columns of any
    other name pass through; an empty table gives an empty table.
    """
    found, verdicts = infer(docs)
    spanned = found.where("size(spans) > 0").select("id0", "h", "spans").dropDuplicates(["id0", "h"])
    text = F.coalesce(F.col("row.text"), F.lit(""))
    keyed = packed(docs).select("row", *_keys(F.col("row.doc_id").cast("long"), text), text.alias("t"))
    out = keyed.join(small(spanned), ["id0", "h"], "left").join(small(verdicts), ["id0", "h"], "left")
    out = out.withColumn("hit", F.col("spans").isNotNull() | F.col("said").isNotNull()).withColumn("spans", F.coalesce("spans", F.array().cast(_SPANS)))
    put = "concat(g, coalesce(element_at(said, lower(get(found, i))), get(found, i), ''))"
    out = out.withColumn("wanted", F.when(F.col("said").isNotNull(), F.expr(_wanted("t", "said"))))
    written = let("regexp_extract_all(p.text, wanted, 0)", "found", f"array_join(transform(split(p.text, wanted, -1), (g, i) -> {put}), '')")
    marks = ", ".join(f"'[{k.upper()}]'" for k in PATTERNS)
    whole = f"array_join(transform({pieces('t', 'spans')}, p -> concat(if(said is null, p.text, {written}), coalesce(get(array({marks}), p.kind), ''))), '')"
    out = out.withColumn("new", F.when(F.col("hit"), F.expr(whole)).otherwise(F.col("row.text")))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("hit"), F.char_length("new").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs, changed)
