"""Operator 3, toxicity by a weighted finite-state pattern grammar.

Words map to symbols: insult, hint (a weaker learned word), threat verb, intent, target, negation, reporting verb, quote mark, soft
end (comma, colon), end, line break. Small transducers follow negation scope, reported speech and intent; their outputs feed two
acceptors, of what a clause has found and of its target, which may stand on either side of the insult. Their composition is one
transition table. It emits nothing for a word: only when a clause ends does it emit the patterns that the whole clause matches (a
lone insult, several, aimed ones, excused ones, threats). Scores are a logistic function of the logs (base 2, of 1 + n) of the matched
clauses' counts.

Lexicon arcs: insults of the grammar's own lists, and arcs over characters that are learned, so that unseen inflections of an
insult match too. A unit is a whole word, or a prefix of 4 to 8 letters that at least 3 words of toxic texts share. It is an
insult (a hint) if at least 0.9 (0.6) of its uses are in toxic texts and a likelihood-ratio test, corrected for the number of units
tested, rules chance out. Uses in toxic texts count once for each (previous word, word, next word), so that copies of a text count
as one; those in clean texts count by (word, text). At most `learned` units, those in most toxic texts, are kept.

Learning uses a bounded sample: at most `sample` labelled rows outside the held-out fifth (crc32 of the doc_id's text modulo 5 is 0
for that), those with the smallest hash of doc_id. From it come the learned arcs and the patterns' weights, fitted with Gaussian
priors around the grammar's own weights as non-negative steps: an aimed clause never scores below a lone one, several insults never
below one, and one aimed insult or threat is enough for 0.5. Without labels the grammar's own weights stand. Labels, language, source and doc_id never
enter a score.

Cases: null and empty texts score the bias alone. A null doc_id keeps its row, is not held out and teaches nothing. Of contradicting
labels of one doc_id the toxic one counts; null labels are none. Repeated rows get equal scores. Texts are read whole, in one pass
with a state of a few numbers. No documents give no rows; other columns are not read, and may have any name."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import cut, table

SAMPLE, LEARNED, CHANCE, STEMS, STEM_WORDS = 20_000, 5_000, 0.01, range(4, 9), 3
#: Shares of a unit's uses in toxic texts from which on it is an insult or a hint.
SURE, LIKELY = 0.9, 0.6
INSULT, HINT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE, SOFT, END, BREAK, OTHER = range(12)
WORDS = {
    INSULT: "idiot idiots moron morons imbecile stupid dumb pathetic worthless loser losers scum trash garbage filth clown disgusting vermin cretin "
    "bastard bitch asshole dumbass idiota imbecil estupido estúpido basura imbécile crétin connard salaud ordure abruti dumm dummkopf trottel "
    "abschaum arschloch vollidiot",
    THREAT: "kill murder hurt destroy stab shoot strangle hang burn beat smash töten umbringen verletzen tuer frapper matar golpear",
    INTENT: "will gonna shall going ll werde werden vais allons voy vamos",
    TARGET: "you your yours yourself u ur youre du dich dir ihr euch toi vous tú usted ustedes he she they them him",
    NEGATION: "not never no nobody isnt arent dont doesnt didnt cannot nicht kein keine nie pas jamais nunca jamás",
    REPORT: "said says saying called calls quoted wrote writes reported claimed alleged sagte schrieb nannte dit disait écrit dijo dice llamó",
}
#: Words after a negation that are in its scope.
SCOPE = 3
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n]|[\"“”«»]")
PUNCT = {**dict.fromkeys(".!?;", END), **dict.fromkeys(",:", SOFT), "\n": BREAK, **dict.fromkeys('"“”«»', QUOTE)}
ENDS = (SOFT, END, BREAK)


# Transducers: number of states and next(state, symbol).
def _negated(s, x):
    return 0 if x in ENDS else SCOPE if x == NEGATION else max(0, s - 1)


def _reported(s, x):
    """0 nothing, 1 after a reporting verb (until the sentence ends), 2 within quotes (until they close or the line ends)."""
    if x == BREAK:
        return 0
    if s == 2:
        return 0 if x == QUOTE else 2
    return 2 if x == QUOTE else 0 if x == END else 1 if x == REPORT else s


def _intended(s, x):
    return 0 if x in ENDS else 2 if x == INTENT else max(0, s - 1)


# Acceptors over (symbol, excused, intended). An end takes them back to their first state.
def _aimed(s, x):
    return 1 if x == TARGET else s


def _insulted(s, x, excused):
    """0 nothing, 1 only excused, 2 a hint, 3 an insult or two hints, 4 more."""
    if x not in (INSULT, HINT):
        return s
    if excused:
        return max(s, 1)
    return (3 if x == INSULT else 2) if s < 2 else 3 if (s, x) == (2, HINT) else 4


def _threatened(s, x, excused, intended):
    """0 nothing, 1 only excused, 2 a threat verb, 3 an intended one."""
    return s if x != THREAT else max(s, 1 if excused else 3 if intended else 2)


#: The grammar's own weights, as what each step adds: from a hint to an insult to several, by a target, from a threat verb to an aimed or
#: intended threat; and the bias. Patterns of clauses that the composed transducer emits, each with the steps that it has taken.
INCREMENTS = {"excused": 0.4, "hint": 1.2, "insult": 1.8, "piled": 1.0, "aimed": 1.5, "threat": 0.3, "meant": 4.2}
PATTERNS = {
    "excused": ["excused"], "hint": ["hint"], "insult": ["hint", "insult"], "piled": ["hint", "insult", "piled"], "hint_aimed": ["hint", "aimed"],
    "insult_aimed": ["hint", "insult", "aimed"], "piled_aimed": ["hint", "insult", "piled", "aimed"], "threat": ["threat"], "threat_aimed": ["threat", "meant"],
}
BUILT = np.array([[float(i in steps) for i in INCREMENTS] for steps in PATTERNS.values()])
BIAS = -2.5
#: One clause of these patterns alone makes a text toxic, with this margin.
ENOUGH, MARGIN = ("insult_aimed", "threat_aimed"), 0.1


def clause_patterns(aim: int, insult: int, threat: int) -> list[int]:
    """The patterns of a clause that ends in these states of the acceptors."""
    names, found = list(PATTERNS), []
    if insult >= 2:
        found.append(("hint", "insult", "piled")[insult - 2] + ("_aimed" if aim else ""))
    if threat >= 2:
        found.append("threat_aimed" if threat == 3 or aim else "threat")
    if not found and (insult or threat):
        found.append("excused")
    return [names.index(x) for x in found]


def compose() -> tuple[list[list[int]], list[list[list[int]]]]:
    """Next state, and emitted patterns, for each state and symbol of the product of all transducers and acceptors."""
    states = list(product(range(SCOPE + 1), range(3), range(3), range(2), range(5), range(4)))
    number = {s: i for i, s in enumerate(states)}
    step, emit = [], []
    for neg, rep, will, aim, insult, threat in states:
        to, out = [], []
        for x in range(OTHER + 1):
            outer = (_negated(neg, x), _reported(rep, x), _intended(will, x))
            excused = neg > 0 or rep > 0
            inner = (0, 0, 0) if x in ENDS else (_aimed(aim, x), _insulted(insult, x, excused), _threatened(threat, x, excused, will > 0))
            to.append(number[outer + inner])
            out.append(clause_patterns(aim, insult, threat) if x in ENDS else [])
        step.append(to)
        emit.append(out)
    return step, emit


STEP, EMIT = compose()
_WORTH = frozenset((INSULT, HINT, THREAT))


class Lexicon(dict):
    """Symbols of tokens; those of new words come from the longest learned unit that they hold. At most a million words are kept."""

    def __init__(self, units: dict[str, int]):
        super().__init__()
        self.units = units
        self.fixed = PUNCT | {w: x for x, ws in WORDS.items() for w in ws.split()}

    def __missing__(self, token: str) -> int:
        x = self.fixed.get(token)
        if x is None:
            parts = (self.units.get(u) for u in [token + "$", *(token[:k] for k in reversed(STEMS) if k < len(token))])
            x = next((p for p in parts if p is not None), OTHER)
        if len(self) > 1_000_000:
            self.clear()
        self[token] = x
        return x


def patterns(text: str | None, lexicon: Lexicon) -> list[int]:
    """How many clauses of a text match each pattern."""
    out = [0] * len(PATTERNS)
    symbols = [lexicon[t] for t in TOKEN.findall((text or "").lower())]
    if _WORTH.isdisjoint(symbols):
        return out
    state = 0
    for x in (*symbols, BREAK):
        for p in EMIT[state][x]:
            out[p] += 1
        state = STEP[state][x]
    return out


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """h (hash of the text), text, toxic, words: one row for each distinct text of the sample, cut."""
    kept = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kept = cut(kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = documents.select("doc_id", "text").join(F.broadcast(kept), "doc_id")  # at most `most` rows
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    return cut(rows.withColumn("words", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("\\p{L}+"), 0)))


def _units(word: str) -> "F.Column":
    stems = ", ".join(f"IF(char_length({word}) > {k}, substring({word}, 1, {k}), NULL)" for k in STEMS)
    return F.explode_outer(F.expr(f"filter(array(concat({word}, '$'), {stems}), x -> x IS NOT NULL)")).alias("u")


def learned_units(sample: DataFrame, most: int = LEARNED) -> dict[str, int]:
    """Learned units and their symbols; `word$` is a whole word. All that is collected is at most `most` units."""
    texts, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).collect()[0]
    if not 0 < toxic < texts:
        return {}
    rate = toxic / texts
    near = "transform(sequence(0, size(words) - 1), i -> struct(words[i] AS w, xxhash64(get(words, i - 1), words[i], get(words, i + 1)) AS c))"
    uses = sample.where("toxic = 1 AND size(words) > 0").select("h", F.inline_outer(F.expr(near))).groupBy("w", "c").agg(F.min("h").alias("h"))
    uses = cut(uses.select("w", "h").where("w IS NOT NULL").distinct())
    bad = uses.select("h", _units("w")).distinct().groupBy("u").agg(F.count("*").alias("bad"))
    forms = uses.select("w").distinct().select(_units("w")).groupBy("u").agg(F.count("*").alias("forms"))
    clean = sample.where("toxic = 0").select(F.explode_outer(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    good = clean.where("w IS NOT NULL").select("n", _units("w")).groupBy("u").agg(F.sum("n").alias("good"))
    met = bad.join(forms, "u").join(good, "u", "left").na.fill(0, ["good"]).where("bad + good >= 3")
    met = cut(met.withColumn("n", F.col("bad") + F.col("good")))
    p, tests = F.col("bad") / F.col("n"), max(met.count(), 1)
    ratio = F.col("bad") * F.log(p / rate) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - p) / (1 - rate))).otherwise(0.0)
    met = met.where((p >= LIKELY) & (p > rate) & (ratio >= float(np.log(tests / CHANCE)))).where(f"endswith(u, '$') OR forms >= {STEM_WORDS}")
    rows = met.orderBy(F.desc("bad"), "u").limit(most).select("u", (p >= SURE).alias("sure")).collect()
    return {r["u"]: INSULT if r["sure"] else HINT for r in rows}


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60) -> np.ndarray:
    """The bias and the patterns' weights: logistic regression on what each pattern adds to a weaker one, with Gaussian priors (variance
    1, of the bias 4) around the grammar's own, by Newton's method over the increments that are not held at zero. So no pattern
    speaks for a text, and a stronger one never counts less than a weaker one, whatever the labels hold."""
    mean = np.array([BIAS, *INCREMENTS.values()])
    precision = np.array([0.25] + [1.0] * len(INCREMENTS))
    beta = mean.copy()
    a = np.column_stack([np.ones(len(x)), x @ BUILT]) if len(x) else np.zeros((0, len(mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - precision * (beta - mean)
        free = (beta > 0) | (g > 0)
        free[0] = True
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(precision)
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        beta += np.clip(step, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0.0)
    out = dict(zip(PATTERNS, BUILT @ beta[1:]))
    for name in ENOUGH:
        out[name] = max(out[name], MARGIN - beta[0])
    out["piled_aimed"] = max(out["piled_aimed"], out["insult_aimed"])
    return np.array([beta[0], *out.values()])


def strength(counts) -> np.ndarray:
    """What numbers of matched clauses weigh: the first 1, each doubling of (1 + n) 1 more."""
    return np.log2(1 + np.array(counts, float).reshape(-1, len(PATTERNS)))


def _counted(units: dict[str, int]):
    def run(batches):
        lexicon = Lexicon(units)
        for batch in batches:
            counts = [patterns(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(counts, pa.list_(pa.int64()))], names=["toxic", "f"])

    return run


def train(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[dict[str, int], list[float]]:
    """The learned units, and the bias and weights of the patterns."""
    sample = training_sample(documents, labels, most)
    units = learned_units(sample)
    cells = sample.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(_counted(units), "toxic long, f array<long>")
    cells = cells.groupBy("f", "toxic").count().collect()  # at most a row for each row of the bounded sample
    x = strength([r["f"] for r in cells])
    beta = fit(x, np.array([r["toxic"] for r in cells], float), np.array([r["count"] for r in cells], float))
    return units, [float(v) for v in beta]


def _scores(texts: list, lexicon: Lexicon, beta: np.ndarray) -> tuple[np.ndarray, list]:
    counts = [patterns(t, lexicon) for t in texts]
    z = beta[0] + strength(counts) @ beta[1:]
    return 1 / (1 + np.exp(-z)), counts


def score(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents with held_out, score and predicted, and the numbers of clauses that match each pattern."""
    units, beta = train(documents, labels, most)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        lexicon, b = Lexicon(units), np.array(beta)
        for batch in batches:
            p, counts = _scores(batch.column("text").to_pylist(), lexicon, b)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "score", "patterns"])

    out = rows.mapInArrow(run, "doc_id long, score double, patterns array<long>")
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "patterns")


def clean(documents: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, whose texts score below 0.5; texts stay in their task."""
    units, beta = train(documents, labels, most)
    schema, at = documents.schema, documents.columns.index("text")

    def run(batches):
        lexicon, b = Lexicon(units), np.array(beta)
        for batch in batches:
            p, _ = _scores(batch.column(at).to_pylist(), lexicon, b)
            yield batch.filter(pa.array(p < 0.5))

    return documents.mapInArrow(run, schema)


def query(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": query}
ORACLE: dict[str, str] = {}
