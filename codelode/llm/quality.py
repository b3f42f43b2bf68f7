"""Quality rules as weak supervision (operator 1).

Every rule looks at a few figures of a document and votes good (1), bad (-1) or abstains (0). No rule
has the last word: expectation-maximisation estimates, from all documents and without labels, how
often each rule casts each vote on good and on bad documents, and a document is kept by its posterior
probability of being good.

The distinct vote patterns, at most 3 to the number of rules, are counted by Spark; only these counts
reach the driver. The figures are made by one Arrow function of the text and the posterior is a plain
expression, so that nothing but pattern counts is shuffled. `assess` makes the figures once and keeps
them as a table; `good_documents` makes them twice, which spares it a join with the texts.

Edge cases: null and empty texts have no words, so fail the base rule; any id, also null or repeated,
is passed through, one row for each row; further columns are ignored by `assess` and kept by
`good_documents`; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import free_name, settled, strings

FIGURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_ended", "n_upper", "n_cased", "n_letters", "n_plain", "n_distinct",
)
_SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\v\f\r"
#: A word as prose has it: letters or digits, at most one mark behind it, quotes or brackets around it.
_PLAIN = re.compile(r"""(?<!\S)["'(«„“‘¿¡]{0,2}\w+(?:[.'’-]\w+)*["')»”’]?[.,;:!?…]?["')»”’]?(?!\S)""")
_LETTER = re.compile(r"[^\W\d_]+")
_END = re.compile(r"""\w["')»”’]?[.!?:…。]["')»”’]?[ \t\v\f\r]*$""")


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    # Numbered anew, so that the third word can't overflow 64 bits.
    _, pairs = np.unique(pairs, return_inverse=True)
    _, place, count = np.unique(
        pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True
    )
    again = count[place] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of a text, in the order of FIGURES."""
    if not text:
        return (0,) * len(FIGURES)
    words = text.encode("utf-8", "replace").split()  # at ASCII white space
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    lower, upper = (
        np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in (text.lower(), text.upper())
    )
    if len(lower) == len(upper) == len(points):
        n_upper, n_cased = int((lower != points).sum()), int((lower != upper).sum())
    else:  # some letters change their number with the case
        n_upper, n_cased = sum(c != c.lower() for c in text), sum(c.lower() != c.upper() for c in text)
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        len(lines),
        sum(_END.search(line) is not None for line in lines),
        n_upper,
        n_cased,
        sum(map(len, _LETTER.findall(text))),
        len(_PLAIN.findall(text)),
        len(set(words)),
    )


def _figures_of(texts: pa.Array) -> pa.Array:
    rows = np.array([figures(text) for text in strings(texts)], np.int64).reshape(-1, len(FIGURES))
    return pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIGURES))], list(FIGURES)
    )


def text_figures(text: str) -> Column:
    """A struct of FIGURES of a text column."""
    return F.arrow_udf(_figures_of, ", ".join(f"{name} long" for name in FIGURES))(F.col(text))


@dataclass(frozen=True)
class Rule:
    """Votes bad if `bad` holds, else good if `good` holds, else abstains. SQL over the figures."""

    name: str
    bad: str
    good: str

    def vote(self, figure: str) -> Column:
        bad, good = (F.expr(condition.replace("{f}", f"`{figure}`")) for condition in (self.bad, self.good))
        return F.when(bad, -1).when(good, 1).otherwise(0)


RULES = (
    Rule("length", "{f}.n_words < 30", "{f}.n_words >= 100"),
    Rule(
        "word_length",
        "{f}.word_chars > 14 * {f}.n_words or {f}.word_chars < 2.5 * {f}.n_words",
        "{f}.word_chars between 3 * {f}.n_words and 10 * {f}.n_words",
    ),
    Rule("symbols", "5 * {f}.n_symbols > {f}.n_words", "50 * {f}.n_symbols <= {f}.n_words"),
    Rule("plain_words", "10 * {f}.n_plain < 7 * {f}.n_words", "10 * {f}.n_plain >= 9 * {f}.n_words"),
    Rule("letters", "100 * {f}.n_letters < 75 * {f}.word_chars", "100 * {f}.n_letters >= 85 * {f}.word_chars"),
    Rule("sentences", "{f}.n_lines > 1 and 10 * {f}.n_ended < 3 * {f}.n_lines", "10 * {f}.n_ended > 6 * {f}.n_lines"),
    Rule("capitals", "3 * {f}.n_upper > {f}.n_cased", "7 * {f}.n_upper <= {f}.n_cased"),
    Rule("dup_lines", "10 * {f}.n_dup_lines > 4 * {f}.n_lines", "{f}.n_lines > 1 and {f}.n_dup_lines = 0"),
    Rule("repeats", "10 * {f}.n_repeat_words > 4 * {f}.n_words", "20 * {f}.n_repeat_words <= {f}.n_words"),
    Rule("variety", "{f}.n_words >= 50 and 5 * {f}.n_distinct < {f}.n_words and {f}.n_words < 500", "2 * {f}.n_distinct > {f}.n_words"),
)


@dataclass(frozen=True)
class Model:
    """Log probabilities of the votes -1, 0, 1 of each rule on bad and good documents."""

    log_prior: tuple[float, float]
    log_vote: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def accuracy(self, rule: int) -> float:
        """How often the rule is right when it votes."""
        bad, good = (np.exp(x) for x in self.log_vote[rule])
        share = np.exp(self.log_prior)
        return float((share[0] * bad[0] + share[1] * good[2])
                     / (share[0] * (bad[0] + bad[2]) + share[1] * (good[0] + good[2])))

    def posterior(self, votes: list[Column]) -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(self.log_prior[1] - self.log_prior[0])
        for vote, (bad, good) in zip(votes, self.log_vote, strict=True):
            odds = odds + F.when(vote == -1, good[0] - bad[0]).when(vote == 1, good[2] - bad[2]).otherwise(
                good[1] - bad[1]
            )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> Model:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their numbers.

    It starts from the votes themselves: a document is taken for bad to the degree of its bad votes.
    One imaginary document per vote and class keeps every probability above 0.
    """
    counts = counts.astype(float)
    cast = np.stack([patterns == vote for vote in (-1, 0, 1)], axis=2).astype(float)
    bad = (patterns == -1).sum(axis=1)
    good = 0.95 * 0.1**bad + 0.01
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        vote = (np.einsum("cp,prv->crv", weight, cast) + 1) / (weight.sum(axis=1)[:, None, None] + 3)
        score = np.log(prior)[:, None] + np.einsum("prv,crv->cp", cast, np.log(vote))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done = not len(new) or np.abs(new - good).max() < tolerance
        good = new
        if done:
            break
    return Model(
        tuple(float(x) for x in np.log(prior)),
        tuple(tuple(tuple(float(x) for x in np.log(vote[c, r])) for c in (0, 1))
              for r in range(patterns.shape[1])),
    )


def learn(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimate the accuracies of the rules on all documents."""
    return learn_from(docs.select(text_figures(text).alias("figure")), "figure", rules)


def learn_from(figures: DataFrame, figure: str, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimate the accuracies of the rules from the figures of all documents."""
    votes = [rule.vote(figure).alias(f"v{k}") for k, rule in enumerate(rules)]
    found = (
        figures.select(*votes)
        .groupBy(*(f"v{k}" for k in range(len(rules)))).count()
        .collect()  # no more than 3 ** len(rules) rows
    )
    rows = sorted(tuple(row) for row in found)
    table = np.array(rows, np.int64).reshape(-1, len(rules) + 1)
    return fit(table[:, :-1], table[:, -1])


def _verdict(model: Model, figure: str, rules: tuple[Rule, ...], threshold: float) -> Column:
    base_failed = F.expr(f"`{figure}`.n_words < 50 or 100 * `{figure}`.n_repeat_words > 50 * `{figure}`.n_words")
    posterior = model.posterior([rule.vote(figure) for rule in rules])
    return F.struct(
        base_failed.alias("base_failed"),
        posterior.alias("quality"),
        (~base_failed & (posterior >= threshold)).alias("kept"),
    )


def assess(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES,
    threshold: float = 0.5,
) -> DataFrame:
    """`key`, the figures, `base_failed`, `quality` (posterior) and `kept` of every document."""
    # The figures are read twice, to estimate and to judge; they are few bytes beside a text.
    figures = settled(docs.select(F.col(key).alias("key"), text_figures(text).alias("figure")), "quality-figures")
    verdict = _verdict(learn_from(figures, "figure", rules), "figure", rules, threshold)
    return figures.withColumn("verdict", verdict).select(F.col("key").alias(key), "figure.*", "verdict.*")


def good_documents(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5
) -> DataFrame:
    """The documents that are kept, with their own columns and no other."""
    model = learn(docs, text, rules)
    figure = free_name(docs, "_figure")
    judged = docs.withColumn(figure, text_figures(text))
    return judged.filter(_verdict(model, figure, rules, threshold)["kept"]).select(*docs.columns)
