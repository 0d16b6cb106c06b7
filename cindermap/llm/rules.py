"""Quality rules as a short-circuit cascade: the rule with most rejections per cost comes first."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 2_000  # expected size of the sample from which costs and rejections are estimated; see ``sample_limit``
_SPACES = "\t\n\v\f\r "
# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"


class Measures:
    """Numbers of one text, each made when a rule or the report first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._known: dict = {}

    def _get(self, name: str, make: Callable):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    @property
    def words(self) -> list[bytes]:
        # bytes.split() parts at ASCII white space only
        return self._get("words", lambda: self.text.encode("utf-8", "surrogatepass").split())

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._get("word_chars", lambda: len(self.text) - sum(map(self.text.count, _SPACES)))

    @property
    def n_symbols(self) -> int:
        return self._get("n_symbols", lambda: sum(map(self.text.count, SYMBOLS)))

    @property
    def n_dup_lines(self) -> int:
        def make():
            lines = [line for line in self.text.split("\n") if line.strip(_SPACES)]
            return len(lines) - len(set(lines))

        return self._get("n_dup_lines", make)

    @property
    def n_lines(self) -> int:
        return self._get("n_lines", lambda: sum(1 for line in self.text.split("\n") if line.strip(_SPACES)))

    @property
    def n_repeat_words(self) -> int:
        """Words inside five-word windows that the text holds twice or more, each once."""

        def make():
            w = self.words
            windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
            if len(set(windows)) == len(windows):
                return 0
            seen, covered, upto = Counter(windows), 0, 0
            for i, x in enumerate(windows):
                if seen[x] > 1:
                    covered += i + 5 - max(i, upto)
                    upto = i + 5
            return covered

        return self._get("n_repeat_words", make)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true of a text that is to go; integers only, so that every engine agrees."""

    name: str
    rejects: Callable[[Measures], bool]


BASE = (
    Rule("few_words", lambda m: m.n_words < 10),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 20 * m.n_words),
)
#: Besides the base: symbols for every third word, words of odd mean length, half of the lines repeated.
RULES = (
    *BASE,
    Rule("symbols", lambda m: 100 * m.n_symbols > 30 * m.n_words),
    Rule("word_length", lambda m: not 2 * m.n_words <= m.word_chars <= 20 * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > 50 * m.n_lines),
)


def sample_limit(rows: int, sample_rows: int) -> int:
    """Rows whose 63-bit hash lies below it are in the sample.

    Each row is in by itself with chance sample_rows / rows, so twice ``sample_rows`` are passed with a chance below
    exp(-0.38 sample_rows): for 2,000, never. The limit is above 0 up to 10^22 rows.
    """
    return min(1 << 63, (sample_rows << 63) // max(rows, 1))


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per text, share rejected), measured on about ``sample_rows`` texts that are not null, or on all if there are no more.

    Each rule is timed with nothing known about the text but what all rules need, its words. The
    sample takes rows by the hash of their position, so copies of a text are drawn one by one; one row per rule and task
    comes back. Timings differ from run to run, and so may the order; the verdict does not. Without rows all estimates are 0.
    """
    present = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull())
    limit = sample_limit(present.count(), sample_rows)
    sampled = present
    if limit < 1 << 63:
        place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)
        sampled = present.withColumn("place", place).filter(F.col("place") < F.lit(limit)).select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, gone, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    m = Measures(value)
                    m.words  # noqa: B018  (shared by the rules, so no rule's own cost)
                    began = time.perf_counter()
                    gone[i] += rule.rejects(m)
                    spent[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": pa.array(range(len(rules)), pa.int32()), "seconds": spent, "gone": pa.array(gone, pa.int64()), "n": pa.array([n] * len(rules), pa.int64())})

    found = sampled.mapInArrow(measure, "rule int, seconds double, gone long, n long").groupBy("rule").agg(F.sum("seconds"), F.sum("gone"), F.sum("n")).collect()
    by_rule = {r[0]: (r[1] / max(r[3], 1), r[2] / max(r[3], 1)) for r in found}
    return [(rule, *by_rule.get(i, (0.0, 0.0))) for i, rule in enumerate(rules)]


def ordered(estimates: Sequence[tuple[Rule, float, float]]) -> tuple[Rule, ...]:
    """Rules by rejected share per second, the most first; ties stay in the order given."""
    return tuple(rule for rule, cost, share in sorted(estimates, key=lambda e: -e[2] / max(e[1], 1e-9)))


_REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule], text: str = "text", report: bool = False, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns and ``kept``: whether no rule rejects the text; the first that does ends the cascade.

    With ``report``, the measures that rules have not asked for are made after the
    verdict, and the base verdict (the rules in ``BASE``) is returned as ``base_failed``. A null text is an empty
    one: it has no words. Whole texts are measured, however long. Rows are judged one by one in Arrow batches, so nothing is shuffled.
    """
    chosen = docs.select(*carry, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]) if carry else ""
    extra = "kept boolean" + ("".join(f", {n} long" for n in _REPORT) + ", base_failed boolean" if report else "")

    def cascade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, base, numbers = [], [], {n: [] for n in _REPORT}
            for value in batch.column(batch.num_columns - 1):
                m = Measures(value.as_py())
                kept.append(not any(rule.rejects(m) for rule in rules))
                if report:
                    base.append(any(rule.rejects(m) for rule in BASE))
                    for n in _REPORT:
                        numbers[n].append(getattr(m, n))
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])} | {"kept": pa.array(kept, pa.bool_())}
            if report:
                out |= {n: pa.array(v, pa.int64()) for n, v in numbers.items()} | {"base_failed": pa.array(base, pa.bool_())}
            yield pa.RecordBatch.from_pydict(out)

    return chosen.mapInArrow(cascade, ", ".join(filter(None, [kinds, extra])))


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", report: bool = False, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Order ``rules`` by what they reject per cost on a sample, then judge every document.

    Null and empty texts have no words, so the base rejects them; repeated rows each return; no rows give no rows. Other columns
    than ``text`` and ``carry`` are not read, and ``carry`` must not name a column of the report.
    """
    return judge(docs, ordered(estimate(docs, rules, text)), text, report, carry)
