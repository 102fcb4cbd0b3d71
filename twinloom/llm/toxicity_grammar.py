"""Toxicity by a weighted finite-state grammar of clauses.

A lexical transducer (a letter tree) maps words to classes: insult, threat, target, negation,
reported speech. Small machines over these classes each track one thing of a clause; their
composition is one machine that reads a clause word by word and ends in its pattern, for
example "insult at a target" or "negated insult in reported speech". Patterns carry weights;
a text's score is the chance that at least one of its matched clauses is toxic, or the
weight of texts without any match.

Closed classes and some insults are word lists. Further insults and all weights are learned: the
learned part of the lexicon is the purest word beginnings that toxic training texts have far more often than chance allows,
corrected for the number of beginnings tried. The fit reads a bounded sample of labelled
rows (MOST_TOXIC and MOST_CLEAN) in whole texts, each group of near copies once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from twinloom.llm.bpe_index import text_groups
from twinloom.llm.common import as_bytes, documents, kept_fields, mix, odd_numbers, stored, tidy, training_rows, word_hashes

MOST_TOXIC = 4000  # labelled rows of each kind that a model learns from
MOST_CLEAN = 12000
LEAST_TEXTS = 3  # toxic texts that a lexicon entry needs
BEGINNINGS = (4, 5, 6, 7)  # letters
MOST_ENTRIES = 5000
CHANCE = 2.5  # times the overall toxic share that texts of one kind may have without any insult
THRESHOLD = 0.3
KNOWN_CHUNKS = 300_000
GROUP_CHARS = 8 << 20

# Fixed word lists of the closed classes (English, German, French, Spanish).
TARGET = "you your yours u he she they him her them du dich dir ihr euch sie tu te toi vous il elle ils elles usted ustedes ellos ellas"
NEGATION = "not no never nor neither without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin ni"
REPORTED = "said says say told called calls quote quoted wrote claimed sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió"
INSULTS = (
    "idiot idiots moron morons loser losers stupid pathetic worthless clown trash scum disgusting dumb jerk imbecile"
    " dummkopf trottel blödmann abschaum erbärmlich connard crétin abruti imbécile débile gilipollas imbécil estúpido inútil"
)
THREAT = "kill hurt destroy beat burn shoot stab punish töten schlagen verbrennen tuer frapper brûler matar golpear quemar"

INSULT_BIT, THREAT_BIT, TARGET_BIT, NEGATION_BIT, REPORTED_BIT, END_BIT = 1, 2, 4, 8, 16, 32
_WORD = regex.compile(r"\p{L}+")
_END = regex.compile(r"[.!?;]")  # a colon ends none: what is reported often follows one


# ---- transducers -------------------------------------------------------------------


class Lexicon:
    """A letter tree: whole words and beginnings with their classes."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: str, bit: int, whole: bool) -> None:
        node = self.root
        for letter in text:
            node = node.setdefault(letter, {})
        key = "whole" if whole else "begin"  # longer than a letter, so no arc
        node[key] = node.get(key, 0) | bit

    def classes(self, word: str) -> int:
        node, found = self.root, 0
        for letter in word:
            node = node.get(letter)
            if node is None:
                return found
            found |= node.get("begin", 0)
        return found | node.get("whole", 0)


class Machine(NamedTuple):
    """A deterministic machine over class symbols: ``step(state, symbol)``, from state 0."""

    states: int
    step: object


def latch(bit: int) -> Machine:
    """Remembers that a class was seen."""
    return Machine(2, lambda state, symbol: 1 if state or symbol & bit else 0)


def negated_insult(reach: int) -> Machine:
    """Whether every insult so far had a negation at most ``reach`` words before it.

    States 0..reach: words since a negation (0: none near), no insult yet; then the same with
    only negated insults; last: an insult without negation.
    """
    plain = 2 * (reach + 1)

    def step(state: int, symbol: int) -> int:
        if state == plain:
            return plain
        seen, near = divmod(state, reach + 1)
        if symbol & (INSULT_BIT | THREAT_BIT):
            if not near:
                return plain
            seen = 1
        near = reach if symbol & NEGATION_BIT else max(near - 1, 0)
        return seen * (reach + 1) + near

    return Machine(plain + 1, step)


def compose(machines: list[Machine], symbols: int) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """The product machine: its table of moves and what each state stands for."""
    start = tuple(0 for _ in machines)
    names, todo, moves = {start: 0}, [start], []
    for state in todo:
        row = []
        for symbol in range(symbols):
            to = tuple(m.step(s, symbol) for m, s in zip(machines, state))
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        moves.append(row)
    return np.array(moves), todo


NEGATION_REACH = 3
MACHINES = [latch(INSULT_BIT), latch(THREAT_BIT), latch(TARGET_BIT), latch(REPORTED_BIT), negated_insult(NEGATION_REACH)]
PATTERNS = 32


def pattern_of(state: tuple[int, ...]) -> int:
    """Number of a clause's pattern; 0: no insult and no threat."""
    insult, threat, target, reported, negation = state
    if not insult and not threat:
        return 0
    negated = int(negation != 2 * (NEGATION_REACH + 1))
    return insult | threat << 1 | target << 2 | reported << 3 | negated << 4


class Grammar:
    """Lexicon and clause machine, applied to texts."""

    def __init__(self, insults: list[tuple[str, bool]]):
        self.lexicon = Lexicon()
        for words, bit in ((INSULTS, INSULT_BIT), (TARGET, TARGET_BIT), (NEGATION, NEGATION_BIT), (REPORTED, REPORTED_BIT), (THREAT, THREAT_BIT)):
            for word in words.split():
                self.lexicon.add(word, bit, True)
        for text, whole in insults:
            self.lexicon.add(text, INSULT_BIT, whole)
        moves, states = compose(MACHINES, END_BIT)
        self.moves = moves.tolist()
        self.pattern = [pattern_of(s) for s in states]
        self.known: dict[str, tuple[int, ...]] = {}

    def symbols(self, chunk: str) -> tuple[int, ...]:
        """Classes of the words in a chunk between blanks, and ends of clauses; neutral ones left out.

        Neutral words still count for the reach of a negation, so runs of them are kept as 0
        in chunks with more than one word.
        """
        found: list[int] = []
        at = 0
        for m in _WORD.finditer(chunk):
            if _END.search(chunk, at, m.start()):
                found.append(END_BIT)
            found.append(self.lexicon.classes(m.group()))
            at = m.end()
        if _END.search(chunk, at):
            found.append(END_BIT)
        return tuple(found)

    def clauses(self, text: str) -> list[int]:
        """Patterns of the clauses of a text that match, in order."""
        chunks = text.lower().split()
        known = self.known
        try:
            rows = [known[c] for c in chunks]
        except KeyError:
            if len(known) > KNOWN_CHUNKS:
                known.clear()
            for c in chunks:
                if c not in known:
                    known[c] = self.symbols(c)
            rows = [known[c] for c in chunks]
        hard = INSULT_BIT | THREAT_BIT
        if not any(s & hard for row in set(rows) for s in row if s != END_BIT):
            return []
        out, state = [], 0
        for row in rows:
            for symbol in row:
                if symbol == END_BIT:
                    if self.pattern[state]:
                        out.append(self.pattern[state])
                    state = 0
                else:
                    state = self.moves[state][symbol]
        if self.pattern[state]:
            out.append(self.pattern[state])
        return out


def prior(pattern: int) -> float:
    """Weight of a pattern before any example: insults count, reported ones half, negated ones too little to decide."""
    chance = 0.7 if pattern & 1 else 0.5 if pattern else 0.0
    return chance * (0.5 if pattern & 8 else 1.0) * (0.35 if pattern & 16 else 1.0)


class Model(NamedTuple):
    insults: list[tuple[str, bool]]
    weights: list[float]  # chance that a clause of this pattern is toxic
    rest: float  # chance for a text without a matched clause


def text_score(patterns: list[int], weights: list[float], rest: float) -> float:
    if not patterns:
        return rest
    clean = 1.0
    for p in patterns:
        clean *= 1 - weights[p]
    return max(rest, 1 - clean)


# ---- learning ----------------------------------------------------------------------


@tidy
def _sketch_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two minhashes of each text over word triples: near copies mostly share one."""
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    odd = odd_numbers(2, 71)
    for batch in batches:
        keys = []
        for text in as_bytes(batch.column("text")):
            words, _ = word_hashes([text])
            if len(words) >= 3:
                words = words[:-2] + words[1:-1] * np.uint64(3) + words[2:] * np.uint64(5)
            h = [mix(words * o).min().astype(np.int64) if len(words) else np.int64(0) for o in odd]
            keys.append(h)
        keys = np.array(keys, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(keys[:, 0]), pa.array(keys[:, 1])], schema=schema
        )


def beginnings(text: str) -> set[tuple[str, bool]]:
    """Words of a text (True) and their beginnings (False)."""
    found = set()
    for word in set(_WORD.findall(text.lower())):
        if len(word) <= 40:
            found.add((word, True))
        for k in BEGINNINGS:
            if len(word) >= k:
                found.add((word[:k], False))
    return found


@tidy
def _count_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("entry", pa.string()), ("whole", pa.bool_()), ("toxic", pa.int64()), ("clean", pa.int64())])
    counts: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for entry in beginnings(text or ""):
                counts.setdefault(entry, [0, 0])[0 if toxic else 1] += 1
    items = list(counts.items())
    for at in range(0, len(items), 50_000):
        some = items[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e for (e, _), _ in some]),
                pa.array([w for (_, w), _ in some]),
                pa.array([c[0] for _, c in some], type=pa.int64()),
                pa.array([c[1] for _, c in some], type=pa.int64()),
            ],
            schema=schema,
        )


def _log_tail(toxic: int, clean: int, share: float) -> float:
    """Log of the chance of at least so many toxic texts among all, if the entry meant nothing."""
    n = toxic + clean
    terms = [
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share)
        for k in range(toxic, n + 1)
    ]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def choose_entries(rows: list[tuple[str, bool, int, int]], share: float, tried: dict[int, int]) -> list[tuple[str, bool]]:
    """Entries that are too often toxic to be chance; of nested ones the purest.

    ``tried``: how many entries occur in at least so many texts.
    """
    good: dict[tuple[str, bool], tuple[int, int]] = {}
    for entry, whole, toxic, clean in rows:
        if toxic < 4 * clean * share / (1 - share) or toxic / (toxic + clean) < 0.6:
            continue
        at_least = max((t for k, t in tried.items() if k >= min(toxic + clean, max(tried))), default=1)
        if _log_tail(toxic, clean, min(0.5, CHANCE * share)) + math.log(max(1, at_least)) < math.log(0.5):
            good[entry, whole] = (toxic, clean)
    # The purest first. Skipped is what a chosen beginning has already, and a beginning whose
    # toxic texts come from longer chosen ones.
    chosen: list[tuple[str, bool]] = []
    begun: set[str] = set()
    longer: dict[str, int] = {}
    pure = lambda e: good[e][0] / (sum(good[e]) + 1)
    for entry, whole in sorted(good, key=lambda e: (-pure(e), len(e[0]), e)):
        toxic = good[entry, whole][0]
        if any(entry[:k] in begun for k in BEGINNINGS) or (not whole and longer.get(entry, 0) >= 0.8 * toxic):
            continue
        chosen.append((entry, whole))
        if not whole:
            begun.add(entry)
        for k in BEGINNINGS:
            if k < len(entry) or (whole and k == len(entry)):
                longer[entry[:k]] = longer.get(entry[:k], 0) + toxic
    chosen.sort(key=lambda e: (-good[e][0], e))
    return chosen[:MOST_ENTRIES]


def _pattern_rows(model_insults, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grammar = Grammar(model_insults)
    schema = pa.schema([("toxic", pa.int32()), ("patterns", pa.list_(pa.int32()))])
    for batch in batches:
        found = [grammar.clauses(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, type=schema.field(1).type)], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Learn from labelled rows: docs (doc_id, text) and labels (doc_id, toxic 0 or 1).

    Rows with a null among these take no part. At most ``most_toxic`` and ``most_clean`` rows
    are read, chosen by a hash of doc_id.
    """
    ids = F.col("doc_id").cast("long").alias("doc_id")
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    marks = marks.select(ids, F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (
        marks.where("toxic = 1").orderBy(*order).limit(most_toxic).unionByName(marks.where("toxic = 0").orderBy(*order).limit(most_clean))
    )
    # The sample has at most most_toxic + most_clean rows of two numbers: it may be broadcast.
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(ids, "text")
    texts = stored(known.join(F.broadcast(sample), "doc_id"))
    keys = texts.mapInArrow(_sketch_keys, "doc_id long, toxic int, a long, b long").collect()
    alone, used_a, used_b = {}, set(), set()
    for doc, toxic, a, b in sorted(keys):  # one of each group of near copies
        if a not in used_a and b not in used_b:
            alone[doc] = toxic
        used_a.add(a)
        used_b.add(b)
    if not alone:
        return Model([], [prior(p) for p in range(PATTERNS)], 0.0)
    only = _only(docs.sparkSession.sparkContext.broadcast(set(alone)))
    n_toxic = sum(alone.values())
    share = (n_toxic + 1) / (len(alone) + 2)
    counts = (
        texts.mapInArrow(lambda batches: _count_beginnings(only(batches)), "entry string, whole boolean, toxic long, clean long")
        .groupBy("entry", "whole")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sizes = F.least(F.col("toxic") + F.col("clean"), F.lit(50)).alias("texts")
    # One pass: the entries that may matter, and how many entries have how many texts.
    rare = F.col("toxic") < LEAST_TEXTS
    weak = F.col("toxic") < 0.6 * (F.col("toxic") + F.col("clean"))
    tally = (
        counts.groupBy(
            F.when(rare | weak, F.lit(None)).otherwise(F.col("entry")).alias("entry"),
            F.when(rare | weak, F.lit(None)).otherwise(F.col("whole")).alias("whole"),
            sizes,
        )
        .agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
        .collect()
    )
    by_size: dict[int, int] = {}
    for r in tally:
        by_size[r["texts"]] = by_size.get(r["texts"], 0) + r["n"]
    tried, total = {}, 0
    for size in sorted(by_size, reverse=True):
        total += by_size[size]
        tried[size] = total
    rows = [(r["entry"], r["whole"], r["toxic"], r["clean"]) for r in tally if r["entry"] is not None]
    insults = choose_entries(rows, share, tried)
    found = clause_patterns(texts, only, insults)
    # Weight of a pattern: toxic share of the texts in which it occurs, drawn to its prior.
    seen = np.zeros((PATTERNS, 2))
    rest = np.zeros(2)
    for toxic, patterns in found:
        if not patterns:
            rest[toxic] += 1
        for p in set(patterns):
            seen[p, toxic] += 1
    weights = [float((seen[p, 1] + 2 * prior(p)) / (seen[p].sum() + 2)) for p in range(PATTERNS)]
    return Model(insults, weights, float((rest[1] + share) / (rest.sum() + 1)))


def _only(chosen):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.filter(pa.array([d in chosen.value for d in batch.column("doc_id").to_pylist()], pa.bool_()))
            if rows.num_rows:
                yield rows

    return run


def clause_patterns(texts: DataFrame, only, insults: list[tuple[str, bool]]) -> list[tuple[int, list[int]]]:
    """Toxic mark and matched patterns of each sampled text."""
    rows = texts.mapInArrow(lambda batches: _pattern_rows(insults, only(batches)), "toxic int, patterns array<int>")
    return [(r[0], r[1]) for r in rows.collect()]


# ---- scoring -----------------------------------------------------------------------

_RESULTS = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_clauses", T.IntegerType())]
)


def _score(shared, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        grammar = Grammar(model.insults)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made: dict[str, list] = {"score": [], "predicted": [], "n_clauses": []}
            for b, e in text_groups([t or "" for t in texts], GROUP_CHARS):
                for text in texts[b:e]:
                    patterns = grammar.clauses(text or "")
                    score = text_score(patterns, model.weights, model.rest)
                    made["score"].append(score)
                    made["predicted"].append(int(score >= THRESHOLD))
                    made["n_clauses"].append(len(patterns))
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], type=f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema
            )

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1), predicted (score of 0.3 or more) and n_clauses (matched clauses).

    Other columns stay, except that results replace columns of the same names. Null and empty
    texts have no clause and get the score of unmatched texts. Rows are independent; repeated
    rows give repeated results and an empty table an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # at most MOST_ENTRIES short strings
    keep = kept_fields(docs, _RESULTS)
    schema = T.StructType(keep + _RESULTS.fields)
    return docs.select(*[f"`{f.name}`" for f in keep]).mapInArrow(_score(shared, to_arrow_schema(schema)), schema)


def op7_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(training_rows())
    model = fit(docs, labels)
    return (
        score_toxicity(docs, model)
        .withColumn("held_out", F.coalesce(~training_rows(), F.lit(False)))
        .select("doc_id", "held_out", "score", "predicted")
    )
