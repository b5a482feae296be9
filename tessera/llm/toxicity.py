"""Toxicity by a weighted finite-state pattern grammar (operator 8).

Small transducers read the words of a clause: insult, threat and target words are marked, negation
and reported speech open a scope, and a threat is a first person, a verb of harm and a target, the
last before or after the verb.  They are composed into one deterministic transducer whose arcs put
out the pattern that a match completes (an insult at a target, a negated one, a threat, …).
A document's score is a logistic of how often its clauses match each pattern.  Insult stems
and pattern weights are learnt from labelled rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import trees
from tessera.llm.common import materialize, remainder, slices
from tessera.llm.rule_ensemble import MAX_LABELLED, labelled_sample

# Closed-class words of the grammar in the corpus's four languages.
NEGATION = frozenset("not never no isn't aren't nicht kein keine nie pas jamais ni nunca sin".split())
REPORT = frozenset("said says wrote quoted reported sagte schrieb dijo escribió dit écrit".split())
TARGET = frozenset("you your you're du dich dir euch ihr tu te toi vous tú ti usted ustedes".split())
THREAT = frozenset("kill hurt destroy murder töten töte umbringen matar mataré matarte tuer tuerai".split())
#: Verbs of harm that hold their target.
AIMED = frozenset(["matarte"])
#: First persons, also as verbs of intent.
SUBJECT = frozenset("i i'll i'm we we'll ich wir je j'vais nous yo voy vamos".split())
#: Verbs that hold their first person.
SUBJECT_IN = frozenset("töte mataré tuerai".split())

#: What a composed match puts out.
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported",
            "threat_target", "threat_other")
#: Log odds that a pattern brings before labels are seen: by occurring, and per log odds of its
#: words; then by the doublings of the text's length, and by themselves.
_PRIOR_ANY = (0.5, 1.0, -1.0, -1.0, 8.0, 0.0)
_PRIOR_MORE = (0.8, 1.0, 0.3, 0.3, 1.0, 0.2)
_PRIOR_LENGTH, _PRIOR_BASE = -0.1, -3.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """States are small integers; ``step`` maps (state, symbol) to (next state, output tag)."""

    size: int
    step: Callable[[int, str], tuple[int, str]]


def scope(symbols: str, words: int, tag: str) -> Transducer:
    """Open a scope of some words at one of the symbols; what is said inside it gets ``tag``."""

    def step(state: int, seen: str) -> tuple[int, str]:
        if seen in symbols:
            return words, ""
        return max(state - 1, 0), tag if state else ""

    return Transducer(words + 1, step)


def near_target(words: int) -> Transducer:
    """Tag a marked word within some words after a target word."""
    return scope("Y", words, "target")


def subject(words: int) -> Transducer:
    """Tag what a first person says or does; verbs may hold theirs."""
    opened = scope("S", words, "subject")

    def step(state: int, seen: str) -> tuple[int, str]:
        if seen == "F":  # opens the scope and is inside it
            return words, "subject"
        return opened.step(state, seen)

    return Transducer(opened.size, step)


def awaited_target(words: int) -> Transducer:
    """Put out a threat at the target that follows a verb of harm within some words."""

    def step(state: int, seen: str) -> tuple[int, str]:
        if seen in "TF":
            return words, ""
        if seen == "Y" and state:
            return 0, "awaited"
        return max(state - 1, 0), ""

    return Transducer(words + 1, step)


def marked() -> Transducer:
    """Insults and threats put out their kind."""
    kinds = {"I": "insult", "T": "threat", "F": "threat", "A": "aimed"}
    return Transducer(1, lambda state, seen: (0, kinds.get(seen, "")))


#: Insult, verb of harm (with its first person, with its target), target, negation, report, first person.
SYMBOLS = ("I", "T", "F", "A", "Y", "N", "R", "S", "-")


@functools.cache
def grammar() -> tuple[dict[tuple[int, str], int], dict[tuple[int, str], str]]:
    """The composition: next state and pattern of each arc, states numbered from 0 at the start."""
    machines = (marked(), near_target(4), scope("N", 3, "negated"), scope("R", 6, "reported"), subject(5), awaited_target(3))
    number = {s: i for i, s in enumerate(product(*(range(m.size) for m in machines)))}
    move, output = {}, {}
    for state, i in number.items():
        for symbol in SYMBOLS:
            arcs = [m.step(s, symbol) for m, s in zip(machines, state)]
            move[i, symbol] = number[tuple(n for n, _ in arcs)]
            kind, *tags = (tag for _, tag in arcs)
            output[i, symbol] = _pattern(kind, {t for t in tags if t})
    return move, output


def _pattern(kind: str, tags: set[str]) -> str:
    if kind == "insult":
        for tag in ("reported", "negated", "target"):
            if tag in tags:
                return f"insult_{tag}"
        return "insult"
    aimed = kind == "aimed" or "awaited" in tags or kind == "threat" and "target" in tags
    if aimed and "subject" in tags and not tags & {"negated", "reported"}:
        return "threat_target"
    return "threat_other" if kind in ("threat", "aimed") else ""


class Scorer:
    """Finds marked words with one automaton and runs the grammar over their clauses only.

    ``lexicon`` maps beginnings of words to the log odds of label 1; one that ends in ``$`` is a
    whole word.  The longest entry counts for a word, and a word counts as an insult if its
    log odds are above zero.
    """

    def __init__(self, lexicon: tuple[tuple[str, float], ...]) -> None:
        self.lexicon = dict(lexicon)
        self.longest = max(map(len, self.lexicon), default=0)
        self.finder = ahocorasick.Automaton()
        for start in [*(k.rstrip("$") for k, v in lexicon if v > 0), *THREAT]:
            self.finder.add_word(start, len(start))
        self.finder.make_automaton()

    def _symbol(self, word: str) -> tuple[str, float]:
        whole = word + "$"
        for k in range(min(len(whole), self.longest), 2, -1):
            weight = self.lexicon.get(whole[:k])
            if weight is not None:
                if weight > 0:
                    return "I", weight
                break
        if word in THREAT:
            return "A" if word in AIMED else "F" if word in SUBJECT_IN else "T", 2.0
        if word in SUBJECT:
            return "S", 0.0
        if word in TARGET:
            return "Y", 0.0
        if word in NEGATION:
            return "N", 0.0
        return ("R" if word in REPORT else "-"), 0.0

    def weights(self, text: str) -> dict[str, float]:
        """Per pattern the log odds of the different words that its matches marked."""
        low = text.lower()
        if not len(self.finder):
            return {}
        found: dict[tuple[str, str], float] = {}
        done = -1
        move, output = grammar()
        for end, length in self.finder.iter(low):
            at = end - length + 1
            if end < done or at and low[at - 1].isalpha():
                continue
            begin = max(low.rfind(mark, 0, at) for mark in ".!?;:\n") + 1
            stop = _CLAUSE_END.search(low, end)
            done = stop.start() if stop else len(low)
            state = 0
            for word in _WORD.findall(low, begin, done):
                symbol, weight = self._symbol(word)
                if (pattern := output[state, symbol]):
                    found[pattern, word] = weight
                state = move[state, symbol]
        out: dict[str, float] = {}
        for (pattern, _), weight in found.items():
            out[pattern] = out.get(pattern, 0.0) + weight
        return out

    def features(self, text: str) -> list[float]:
        found = self.weights(text)
        return [*(float(p in found) for p in PATTERNS), *(min(found.get(p, 0.0), 40.0) for p in PATTERNS),
                math.log2(1 + text.count(" ")) if found else 0.0]


@functools.cache
def scorer(lexicon: tuple[tuple[str, float], ...]) -> Scorer:
    return Scorer(lexicon)


def stem_statistics(sample: DataFrame, *, longest: int = 12) -> DataFrame:
    """Per beginning of a word (3 to ``longest`` letters, ``$`` after a whole word) how often rows
    of label 1 and all rows hold a word with it, and the number of different words before it in
    rows of label 1.

    Copies of one text repeat a rare word after the same word, so they don't add contexts.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{1,64}"), F.lit(0))
    with_before = F.arrays_zip(F.col("w").alias("word"),
                               F.concat(F.array(F.lit("")), F.col("w")).alias("before"))
    alone = F.transform("w", lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("before")))
    held = F.when(F.col("label") == 1, F.concat(alone, with_before)).otherwise(alone)
    seen = sample.select("label", words.alias("w")).select("label", F.explode(F.array_distinct(held)).alias("p"))
    once = F.col("before").isNull()
    per_word = (seen.select("label", "p.word", "p.before").filter(F.length("word") >= 3)
                .groupBy("word", "before").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
                .groupBy("word").agg(F.sum(F.when(once, F.col("pos"))).alias("pos"),
                                     F.sum(F.when(once, F.col("n"))).alias("n"),
                                     F.count("before").alias("contexts")))
    whole = F.concat("word", F.lit("$"))
    stems = F.transform(F.sequence(F.lit(3), F.least(F.length(whole), F.lit(longest))),
                        lambda k: F.substring(whole, F.lit(1), k))
    return per_word.select(F.explode(stems).alias("stem"), "pos", "n", "contexts").groupBy("stem").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum("contexts").alias("contexts"))


def one_of_each(sample: DataFrame) -> DataFrame:
    """Of rows that agree in the least hash of their three-word shingles the one of least id.

    Copies of a text fall together as often as they are alike; what they repeat is no evidence.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    rows = sample.select("doc_id", w.alias("w")).select("doc_id", F.array_min(F.transform(
        F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, 1 << 30).alias("b"), F.slice("w", 3, 1 << 30).alias("c")),
        lambda s: F.xxhash64(s["a"], s["b"], s["c"]))).alias("m"))
    first = rows.filter(F.col("m").isNotNull()).groupBy("m").agg(F.min("doc_id").alias("doc_id"))
    # As many rows at most as the sample.
    return sample.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi")


def choose_stems(known: dict[str, int], branch: float = 0.5) -> list[str]:
    """Of candidate stems and their counts keep those at which words branch out into endings."""
    children: dict[str, list[str]] = {}
    for stem in known:
        children.setdefault(stem[:-1], []).append(stem)
    chosen, open_ = [], [s for s in known if s[:-1] not in known]
    while open_:
        stem = open_.pop()
        below = children.get(stem, [])
        if below and max(known[c] for c in below) >= branch * known[stem]:
            open_ += below
        else:
            chosen.append(stem)
    return sorted(chosen)


def learn_lexicon(sample: DataFrame, *, min_contexts: int = 5, context_share: float = 0.4,
                  min_ratio: float = 8.0, min_z: float = 8.0, most: int = 5_000) -> tuple[tuple[str, float], ...]:
    """Stems far likelier in rows of label 1, and their endings that are not, with log odds.

    A candidate has ``min_contexts`` different words before it and as many as ``context_share``
    of its rows, is ``min_ratio`` times likelier under label 1 and ``min_z`` standard deviations
    above chance; of more than ``most`` those with the most contexts stay.  Of near copies in the
    sample one is read.
    """
    sample = materialize(one_of_each(sample))
    totals = sample.agg(F.sum("label"), F.count("*")).first()
    positive, rows = totals[0] or 0, totals[1]
    if not 0 < positive < rows:
        return ()
    share = positive / rows
    base = float(np.log(positive / (rows - positive)))
    table = stem_statistics(sample)
    odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5)) - F.lit(base)
    z = (F.col("pos") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
    # Read twice below; beginnings of fewer than five rows serve neither time.
    table = materialize(table.filter("n >= 5").select(
        "stem", "pos", "n", "contexts", odds.alias("odds"), z.alias("z")))
    found = (table.filter((F.col("contexts") >= F.greatest(F.lit(min_contexts), context_share * F.col("pos")))
                          & (F.col("odds") >= float(np.log(min_ratio)))
                          & (F.col("z") >= min_z))
             .orderBy(F.desc("contexts"), "stem").limit(most).collect())
    stems = choose_stems({r.stem: r.pos for r in found})
    lexicon = {r.stem: min(r.odds, 6.0) for r in found if r.stem in set(stems)}
    if stems:
        # Longer beginnings that speak against their stem; the list of stems is bounded by `most`.
        own = F.broadcast(sample.sparkSession.createDataFrame([(s,) for s in stems], "own string"))
        lengths = sorted({len(s) for s in stems})
        starts = F.array(*[F.substring("stem", 1, k) for k in lengths])
        against = (table.filter(F.col("odds") < 1.0)
                   .withColumn("own", F.explode(F.array_distinct(starts)))
                   .filter(F.length("own") < F.length("stem")).join(own, "own")
                   .select("stem", "odds").distinct().orderBy("stem").limit(most).collect())
        lexicon |= {r.stem: min(r.odds, 0.0) for r in against}
    return tuple(sorted(lexicon.items()))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[tuple[str, float], ...]
    weights: tuple[float, ...]


def _prior() -> np.ndarray:
    return np.array([*_PRIOR_ANY, *_PRIOR_MORE, _PRIOR_LENGTH, _PRIOR_BASE])


def _scored(df: DataFrame, keep: Sequence[str], model: ToxicityModel, text: str, out: str,
            features: bool = False) -> DataFrame:
    """The columns ``keep``, and ``out``: the score, or the features that it is made of."""

    def run(batches):
        grammar_of = scorer(model.lexicon)
        w = np.array(model.weights)
        for batch in batches:
            for part in slices(batch, text):
                x = np.array([grammar_of.features(t or "") for t in part.column(text).to_pylist()])
                made = (pa.array(x.tolist(), pa.list_(pa.float64())) if features
                        else pa.array(trees.sigmoid(x @ w[:-1] + w[-1])))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), made], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, *({text} - set(keep))).mapInArrow(
        run, f"{kinds}, `{out}` {'array<double>' if features else 'double'}")


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", *,
          limit: int = MAX_LABELLED) -> ToxicityModel:
    """Stems and weights from at most ``limit`` labelled rows.

    Weights are drawn towards the grammar's own, so patterns that no label shows keep those.
    """
    sample = labelled_sample(documents, labels, label, limit=limit)
    lexicon = learn_lexicon(sample)
    blank = ToxicityModel(lexicon, tuple(_prior()))
    rows = (_scored(sample, ["doc_id", "label"], blank, "text", "made", features=True)
            .orderBy("doc_id").select("label", "made").toPandas())
    if not len(rows):
        return blank
    x = np.array(rows["made"].tolist(), float)
    w = trees.ridge_logistic(x, rows["label"].to_numpy(float), _prior(), strength=0.5)
    return ToxicityModel(lexicon, tuple(float(v) for v in w))


def score(documents: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), *,
          text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` and the score; null and empty texts have the score of no match."""
    return _scored(documents, list(keep), model, text, out)


def classify(documents: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1,
             threshold: float = 0.7, limit: int = MAX_LABELLED) -> DataFrame:
    """Score every document; labels are learnt from outside the held-out fold only."""
    model = train(documents, labels.filter(remainder("doc_id", folds) != held), limit=limit)
    return score(documents, model).select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
