"""Operator 1, information-theoretic sanitisation, in DataFrame functions only.

Protected entities are the personal data that patterns find: e-mail and IP addresses, card and phone numbers (numbers compare by
their digits), and key-like secrets (runs of 20 and more letters and digits that alternate as random strings do). Each stands for
its levels of generalisation as well: the mail domain, the first two parts of an address, a card's issuer prefix, a phone's area,
and the kind itself. All words of a text outside its spans are the context of every entity in it, and the corpus tells how strongly
a term reveals an entity, be it a value or a level:

    IC(e) = ln(N / df(e))      PMI(e; t) = ln(N * df(e, t) / (df(e) * df(t)))      disclosure = PMI / IC

N, df(e), df(t) and df(e, t) all count distinct whole texts (copies of a text are one). A term discloses an entity if its ratio
reaches `disclosure` and their meeting is no chance: the Chernoff bound on at least df(e, t) of df(e) texts holding t, times the
number of pairs tested, is at most `chance`. Two texts can be enough for a rare entity and a rare term; an entity of a single text
never passes, as each word that only this text has would disclose it. Such a term is as good as the entity itself and is masked
wherever it stands in a text that holds the entity: a number becomes <NUM>, a capitalised word <NAME>, any other is removed. Values
are generalised to their kind: <EMAIL>, <IP>, <CARD>, <PHONE> or <SECRET>.

Patterns are scanned leftmost without overlap for each kind. They use possessive groups, so that no text makes the matcher go back
or run deep; starts inside a run whose head has failed are skipped by look-behind. Matches that fail their test (range, digits,
Luhn) are dropped without a retry. Offsets are code points, ends exclusive, from the pieces that split() leaves between matches.

Cases: null text counts as empty, and has no spans; its text stays null when sanitised. A null doc_id is read like any other.
Repeated rows each get their row. Texts are whole. Only entities of two texts or more and terms rare enough for the ratio are
paired, so that a text of many spans and words isn't multiplied out; all counts are map-side combined. No documents give no rows;
other columns pass unread, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import BROADCAST_ROWS, SPACE, cut, small, spread_join, table

KINDS = ["email", "ip", "card", "phone"]
#: Names of all kinds of spans, by number.
SPANS = [*KINDS, "term", "secret"]
TERM, SECRET = 4, 5
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
#: Whole runs of digits with single separators, of 14 to 19 digits, and of 10 to 15 after a plus: other runs would be dropped anyway.
CARD = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = "\\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])"
#: Key-like runs. Random strings go from a letter to a digit and back time and again; names and slugs hardly do.
KEY_LIKE = "(?<![A-Za-z0-9_+-])[A-Za-z0-9_+-]{20,}+"
DISCLOSURE, CHANCE = 0.85, 0.01
CORE = "^[^\\p{L}\\p{N}]*(.*?)[^\\p{L}\\p{N}]*$"
SPAN = "struct<kind:int,s:int,e:int,v:string>"


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(kind: int, pattern: str, guard: str, keep: str) -> str:
    """SQL for the array of spans of one kind in _t: pieces between matches and matches alternate."""
    found, pieces = f"regexp_extract_all(_t, {_lit(pattern)}, 0)", f"split(_t, {_lit(pattern)})"
    fold = (
        f"aggregate(zip_with({found}, {pieces}, (m, p) -> struct(m AS m, char_length(p) AS gap)), "
        f"named_struct('at', 0, 'out', cast(array() AS array<{SPAN}>)), "
        f"(a, x) -> IF(x.m IS NULL, a, named_struct('at', a.at + x.gap + char_length(x.m), 'out', "
        f"IF({keep.replace('@', 'x.m')}, array_append(a.out, named_struct('kind', {kind}, 's', a.at + x.gap, 'e', a.at + x.gap + char_length(x.m), 'v', x.m)), a.out))), a -> a.out)"
    )
    return f"IF({guard}, {fold}, cast(array() AS array<{SPAN}>))"


def base_spans() -> str:
    """SQL for the array of all base spans of the column _t, by start and then kind."""
    parts = [
        _scan(0, EMAIL, "contains(_t, '@')", "true"),
        _scan(1, IP, f"_t RLIKE {_lit(IP)}", "forall(split(@, '[.]'), q -> char_length(ltrim('0', q)) <= 3 AND cast(concat('0', right(q, 3)) AS int) <= 255)"),
        _scan(2, CARD, f"_t RLIKE {_lit(CARD)}", "luhn_check(regexp_replace(@, '[ -]', ''))"),
        _scan(3, PHONE, "contains(_t, '+')", "true"),
    ]
    return f"array_sort(concat({', '.join(parts)}), (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE l.kind - r.kind END)"


def secret_spans() -> str:
    """SQL for the array of key-like secrets of the column _t."""
    return _scan(SECRET, KEY_LIKE, f"_t RLIKE {_lit(KEY_LIKE)}", "regexp_count(@, '[A-Za-z][0-9]') >= 3")


def _digest(spans: str) -> str:
    names = f"array({', '.join(repr(x) for x in SPANS)})"
    return f"array_join(transform({spans}, x -> concat(element_at({names}, x.kind + 1), ':', x.s, ':', x.e)), ',')"


#: Base spans and secrets, by start.
ALL = "array_sort(concat(_spans, _secrets), (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE l.kind - r.kind END)"


def with_spans(documents: DataFrame) -> DataFrame:
    """_key (hash of the text), _t (text or empty), _spans (base spans), _secrets, and the row itself as _row."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("_t"))
    return rows.withColumn("_spans", F.expr(base_spans())).withColumn("_secrets", F.expr(secret_spans()))


def entities(found: DataFrame, classes: bool = True) -> DataFrame:
    """_key and entity of the spans of _all, once for each distinct text: kind:value, and with `classes` kind/level and kind."""
    kind = f"element_at(array({', '.join(repr(x) for x in SPANS)}), x.kind + 1)"
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    address = "regexp_replace(x.v, '(?<![0-9])0+(?=[0-9])', '')"
    value = f"CASE x.kind WHEN 0 THEN lower(x.v) WHEN 1 THEN {address} WHEN {SECRET} THEN x.v ELSE {digits} END"
    level = f"CASE x.kind WHEN 0 THEN lower(substring_index(x.v, '@', -1)) WHEN 1 THEN substring_index({address}, '.', 2) WHEN 2 THEN left({digits}, 6) WHEN 3 THEN left({digits}, 4) END"
    names = f"array(concat({kind}, ':', {value})" + (f", concat({kind}, '/', {level}), {kind})" if classes else ")")
    each = F.explode_outer(F.expr(f"array_distinct(flatten(transform(_all, x -> {names})))")).alias("entity")
    return found.select("_key", each).where("entity IS NOT NULL").distinct()


def terms(held: DataFrame) -> DataFrame:
    """_key and term of the words outside the base spans, once for each distinct text. Punctuation around a word is no part of it."""
    # Spans may overlap. A piece reaches from the furthest end so far to the next start, less the words that a span cuts.
    pieces = """aggregate(array_append(_all, named_struct('kind', 9, 's', char_length(_t), 'e', char_length(_t), 'v', '')),
        named_struct('at', 0, 'out', cast(array() AS array<struct<a:int,b:int>>)),
        (a, x) -> named_struct('at', greatest(a.at, x.e), 'out', IF(x.s > a.at, array_append(a.out, named_struct('a', a.at, 'b', x.s)), a.out)), a -> a.out)"""
    pieces = held.select("_key", "_t", F.explode_outer(F.expr(pieces)).alias("_p")).where("_p IS NOT NULL")
    word, gap = "[^\\\\x20\\\\x09-\\\\x0D]", "substring(_t, _p.a + 1, _p.b - _p.a)"
    inner = f"IF(_p.a > 0, regexp_replace({gap}, '^{word}++', ''), {gap})"
    pieces = pieces.select("_key", F.expr(inner).alias("_c"), F.expr("_p.b < char_length(_t)").alias("_cut"))
    pieces = pieces.select("_key", F.expr(f"IF(_cut, regexp_replace(_c, '(?<!{word}){word}++$', ''), _c)").alias("_c"))
    own = F.array_distinct(F.transform(F.split(F.lower("_c"), SPACE), lambda w: F.regexp_extract(w, CORE, 1)))
    return pieces.select("_key", F.explode_outer(own).alias("term")).where("term <> ''").distinct()


def disclosures(documents: DataFrame, keyed: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> DataFrame:
    """(_key, entity, term, ratio) of the terms that disclose an entity over the whole corpus, for each text that holds both."""
    none = keyed.select("_key", "entity", F.lit("").alias("term"), F.lit(0.0).alias("ratio")).limit(0)
    live = cut(keyed.groupBy("entity").agg(F.count("*").alias("df_e")).where("df_e > 1"))
    top = live.agg(F.max("df_e")).collect()[0][0]
    if top is None:
        return none
    hashed = documents.select(F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("_t"))
    copies = cut(hashed.groupBy("_key").agg(F.count("*").alias("_n")))
    n = copies.count()
    keyed = cut(spread_join(keyed, live, ["entity"], "df_e", ["_key"]))
    held = hashed.join(small(cut(keyed.select("_key").distinct())), "_key", "left_semi")
    held = held.withColumn("_spans", F.expr(base_spans())).withColumn("_secrets", F.expr(secret_spans())).withColumn("_all", F.expr(ALL))
    near = cut(terms(held))
    # A term of one text passes with no entity; one that is near live entities in too many texts reaches the ratio with none.
    most = 1.000001 * top**disclosure * n ** (1.0 - disclosure)
    low = cut(near.groupBy("term").agg(F.count("*").alias("_low")).where((F.col("_low") > 1) & (F.col("_low") <= most)))
    near = cut(near.join(small(low.select("term")), "term", "left_semi"))
    pairs = cut(near.join(keyed, "_key").groupBy("entity", "term").agg(F.count("*").alias("df_et"), F.first("df_e").alias("df_e")))
    tested = max(pairs.count(), 1)
    pairs = pairs.join(low, "term").where((F.col("df_et") > 1) & (F.col("_low") <= 1.000001 * F.col("df_et") * F.pow(F.lit(float(n)) / F.col("df_e"), F.lit(1.0 - disclosure))))
    pairs = cut(pairs.drop("_low"))
    wanted = cut(pairs.select("term").distinct())
    if wanted.isEmpty():
        return none
    own = F.array_distinct(F.transform(F.split(F.lower("_t"), SPACE), lambda w: F.regexp_extract(w, CORE, 1)))
    # Copies weigh one together, so that counts combine on the map side and no pair of text and term is sent.
    one = small(cut(copies.where("_n > 1")), 2 * BROADCAST_ROWS)
    df = hashed.join(one, "_key", "left").select((1.0 / F.coalesce("_n", F.lit(1))).alias("_part"), F.explode_outer(own).alias("term"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        df = df.join(F.broadcast(wanted), "term", "left_semi")
    df = df.groupBy("term").agg(F.round(F.sum("_part")).alias("df_t"))
    ic = F.log(F.lit(float(n)) / F.col("df_e"))
    pmi = F.log(F.lit(float(n)) * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    # ln of the Chernoff bound, k of m texts holding a term of rate q.
    k, m, q = F.col("df_et"), F.col("df_e"), F.col("df_t") / F.lit(float(n))
    bound = -k * F.log(k / (m * q)) - F.when(m > k, (m - k) * F.log((m - k) / (m * (F.lit(1.0) - q)))).otherwise(F.lit(0.0))
    sure = (k > m * q) & (bound + F.log(F.lit(float(tested))) <= F.log(F.lit(chance)))
    scored = pairs.join(df, "term").withColumn("ratio", F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))).where(sure & (F.col("ratio") >= disclosure))
    flagged = small(cut(scored.select("entity", "term", "ratio")))
    return near.join(keyed.select("_key", "entity"), "_key").join(flagged, ["entity", "term"])


def places(documents: DataFrame, flagged: DataFrame) -> DataFrame:
    """_k (hash of a text) and _more: the places (kind 4) where terms stand that disclose an entity of the text."""
    flagged = cut(flagged.select("_key", "term").distinct())
    keys = small(cut(flagged.select("_key").distinct()))
    texts = documents.select(F.xxhash64("text").alias("_key"), F.coalesce("text", F.lit("")).alias("_t")).join(keys, "_key", "left_semi").dropDuplicates(["_key"])
    word = "'[^\\\\x20\\\\x09-\\\\x0D]+'"
    words = texts.select("_key", F.posexplode_outer(F.expr(f"zip_with(regexp_extract_all(_t, {word}, 0), split(_t, {word}), (m, p) -> struct(m AS m, char_length(p) AS gap))")).alias("_i", "_x")).where("_x.m IS NOT NULL")
    # Every word's end is the running sum of gaps and words, in a window over one text.
    end = F.sum(F.col("_x.gap") + F.char_length("_x.m")).over(Window.partitionBy("_key").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    lead = F.char_length(F.regexp_extract("_x.m", "^[^\\p{L}\\p{N}]*", 0))
    words = words.select("_key", F.regexp_extract("_x.m", CORE, 1).alias("word"), (end - F.char_length("_x.m") + lead).cast("int").alias("s"))
    words = words.select("_key", F.lower("word").alias("term"), "s", (F.col("s") + F.char_length("word")).alias("e"))
    hits = words.join(flagged, ["_key", "term"]).groupBy(F.col("_key").alias("_k"))
    return hits.agg(F.collect_list(F.struct(F.lit(TERM).alias("kind"), "s", "e", F.col("term").alias("v"))).alias("_more"))


#: Places of terms within another span are part of it.
BOTH = f"concat(_all, filter(coalesce(_more, cast(array() AS array<{SPAN}>)), x -> NOT exists(_all, y -> x.s < y.e AND x.e > y.s)))"


def find(documents: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE, classes: bool = True) -> DataFrame:
    """doc_id, _key, _base and _all (arrays of spans; kind 4: a disclosing term, 5: a secret), a row for each row of the input."""
    rows = cut(with_spans(documents.select("doc_id", "text")).select("_row.doc_id", "_key", "_spans", F.expr(ALL).alias("_all")))
    hits = cut(places(documents, disclosures(documents, cut(entities(rows, classes)), disclosure, chance)))
    met = rows.join(small(hits), F.col("_key") == F.col("_k"), "left")
    both = F.expr(f"array_sort({BOTH}, (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE l.kind - r.kind END)")
    return met.select("doc_id", "_key", F.col("_spans").alias("_base"), both.alias("_all"))


def sanitise(documents: DataFrame, disclosure: float = DISCLOSURE, chance: float = CHANCE, classes: bool = True) -> DataFrame:
    """The documents with masked text; all other columns as they were, n_chars anew where there is one."""
    found = with_spans(documents.select("text")).select("_key", F.expr(ALL).alias("_all"))
    hits = cut(places(documents, disclosures(documents, cut(entities(found, classes)), disclosure, chance)))
    rows = with_spans(documents).withColumn("_all", F.expr(ALL)).join(small(hits), F.col("_key") == F.col("_k"), "left")
    spans = F.expr(f"array_sort({BOTH}, (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE r.e - l.e END)")
    term = "CASE WHEN substring(_t, x.s + 1, 1) RLIKE '[0-9]' THEN '<NUM>' WHEN substring(_t, x.s + 1, 1) RLIKE '\\\\p{Lu}' THEN '<NAME>' ELSE '' END"
    name = f"CASE x.kind WHEN {TERM} THEN {term} ELSE element_at(array('<EMAIL>', '<IP>', '<CARD>', '<PHONE>', '', '<SECRET>'), x.kind + 1) END"
    mask = f"""aggregate(_sorted, named_struct('at', 0, 'out', ''), (a, x) -> IF(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out),
        named_struct('at', x.e, 'out', concat(a.out, substring(_t, a.at + 1, x.s - a.at), {name}))), a -> concat(a.out, substring(_t, a.at + 1)))"""
    masked = F.when(F.col("_row.text").isNull(), F.lit(None)).when(F.size("_sorted") == 0, F.col("_row.text")).otherwise(F.expr(mask))
    rows = rows.withColumn("_sorted", spans).select("_row", masked.alias("_text"))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in documents.columns])


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.expr(f"cast(size(filter(_base, x -> x.kind = {k})) AS bigint)").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", n(0), n(1), n(2), n(3), F.sha2(F.expr(_digest("_base")), 256).alias("base_sha256"), F.expr(_digest("_all")).alias("spans"))


def query(spark, sf_dir):
    return digest(find(table(spark, sf_dir, "documents")))


QUERIES = {"op1_pii": query}
ORACLE: dict[str, str] = {}
