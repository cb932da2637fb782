"""Quality rules as learned decision lists, in Spark expressions only.

Statistics of each text are built-in expressions over its word and line arrays. Rules are learned by sequential covering:
conjunctions of thresholds are grown by information gain on two thirds of the labelled statistics, pruned on the other third,
kept if precise enough, and the rows that a rule covers go before the next one is grown. The list becomes one CASE
expression, rule by rule. Learning sees a bounded sample of labelled rows' statistics (numbers, no texts) on the driver.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Regular expressions in Spark's syntax: what parts words, symbols of interest; fixed values.
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
SEPARATE = (
    "symbols_per_word",
    "repeat_share",
    "dup_line_share",
    "distinct_share",
    "mean_word",
    "upper_share",
    "bangs_per_word",
    "words_per_line",
    "log_words",
)
#: Names that the operator gives; the base statistics come first.
TAKEN = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *SEPARATE}
#: Columns in between.
HELPERS = {"__text", "__w", "__l", "__symbols", "__upper", "__bangs", "__distinct", "__n_lines"}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.name] >= self.cut if self.above else row[self.name] <= self.cut

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.cut) if self.above else F.col(self.name) <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<='} {self.cut:.6g}"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those that rules use.

    Every row is worked on by itself: no shuffle. A null text has no words and zeros throughout; a text of any length is
    taken whole; columns of docs that have the name of a statistic or of a column in between (HELPERS) give way.
    """
    own = [c for c in docs.columns if c.lower() not in TAKEN and c.lower() not in HELPERS]
    raw = docs.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))

    def let(value: str, name: str, body: str) -> str:
        """body with value under a name, worked out once: a lambda's own variable is never computed again."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    # starts of windows that occur again: sorted by (hash, position), those with an equal neighbour
    again = "sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h)), x -> x.i))"
    covered = f"aggregate(transform(p, (x, k) -> if(k = size(p) - 1, {WINDOW}, least({WINDOW}, p[least(k + 1, size(p) - 1)] - x))), 0, (a, x) -> a + x)"
    repeats = let("sort_array(transform(wins, (h, i) -> struct(h AS h, i AS i)))", "s", let(again, "p", covered))
    windows = f"if(size(hs) > {WINDOW}, transform(sequence(0, size(hs) - {WINDOW}), i -> xxhash64(slice(hs, i + 1, {WINDOW}))), cast(array() AS array<bigint>))"
    counts = f"struct(size(ws) AS n_words, length(array_join(ws, '')) AS word_chars, size(array_distinct(hs)) AS distinct_words, if(size(array_distinct(wins)) = size(wins), 0, {repeats}) AS n_repeat_words)"
    by_word = let(f"filter(split(__text, '{BLANKS}'), w -> w <> '')", "ws", let("transform(ws, w -> xxhash64(w))", "hs", let(windows, "wins", counts)))
    by_line = let("filter(split(__text, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "ls", "struct(size(ls) AS n_lines, size(ls) - size(array_distinct(ls)) AS n_dup_lines)")
    counted = raw.selectExpr(*(f"`{c}`" for c in own), f"{by_word} AS __w", f"{by_line} AS __l", f"regexp_count(__text, '{SYMBOLS}') AS __symbols", "regexp_count(__text, '[A-Z]') AS __upper", "regexp_count(__text, '!') AS __bangs")
    base = counted.select(
        *own,
        *(F.col(f"__w.{n}").cast("long").alias(n) for n in ("n_words", "word_chars", "n_repeat_words")),
        F.col("__w.distinct_words").alias("__distinct"),
        F.col("__l.n_lines").alias("__n_lines"),
        F.col("__l.n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("__symbols").cast("long").alias("n_symbols"),
        "__upper",
        "__bangs",
    )
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("__n_lines", F.lit(1))
    return base.select(
        *own,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("__distinct") / words).alias("distinct_share"),
        (F.col("word_chars") / words).alias("mean_word"),
        (F.col("__upper") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
        (F.col("__bangs") / words).alias("bangs_per_word"),
        (F.col("n_words") / lines).alias("words_per_line"),
        F.log1p("n_words").alias("log_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """What a condition gains: covered positives times the bits saved on each."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else float("-inf")


def _count(rows: list[dict], rule: list[Condition]) -> tuple[int, int]:
    p = n = 0
    for r in rows:
        if all(c.holds(r) for c in rule):
            p, n = p + r["bad"], n + (not r["bad"])
    return p, n


def _grow(rows: list[dict], names: tuple[str, ...], cuts: dict[str, list[float]], longest: int) -> list[Condition]:
    rule: list[Condition] = []
    left = rows
    while len(rule) < longest:
        p0 = sum(r["bad"] for r in left)
        n0 = len(left) - p0
        if not p0 or not n0:
            break
        best, most = None, 0.0
        for name in names:
            values = sorted((r[name], r["bad"]) for r in left)
            edges = cuts[name]
            at = p = n = 0
            for cut in edges:  # one sweep counts below-or-equal for every cut
                while at < len(values) and values[at][0] <= cut:
                    p, n, at = p + values[at][1], n + (not values[at][1]), at + 1
                if (g := _gain(p0, n0, p, n)) > most:
                    best, most = Condition(name, False, cut), g
            at = len(values) - 1
            p = n = 0
            for cut in reversed(edges):
                while at >= 0 and values[at][0] >= cut:
                    p, n, at = p + values[at][1], n + (not values[at][1]), at - 1
                if (g := _gain(p0, n0, p, n)) > most:
                    best, most = Condition(name, True, cut), g
        if best is None:
            break
        rule.append(best)
        left = [r for r in left if best.holds(r)]
    return rule


def learn_list(rows: list[dict], names: tuple[str, ...] = SEPARATE, most_rules: int = 12, longest: int = 4, precision: float = 0.95, least: int = 5, cuts: int = 48) -> list[list[Condition]]:
    """Ordered rules that tell bad rows (each row: statistics, `bad`, `fold`); rows with fold 0 prune, others grow.

    Ties go to the earlier statistic and the smaller cut, so the list depends on the rows alone. No bad or no good rows: no
    rules.
    """
    edges = {}
    for name in names:
        values = sorted({r[name] for r in rows})
        if len(values) > cuts:
            values = [values[(i * (len(values) - 1)) // (cuts - 1)] for i in range(cuts)]
        edges[name] = sorted({(a + b) / 2 for a, b in zip(values, values[1:], strict=False)})
    found: list[list[Condition]] = []
    grow, prune = [r for r in rows if r["fold"]], [r for r in rows if not r["fold"]]
    while len(found) < most_rules:
        rule = _grow(grow, names, edges, longest)
        if not rule:
            break

        def worth(k: int, rule=rule) -> tuple[float, int]:
            p, n = _count(prune, rule[:k])
            return ((p + 1) / (p + n + 2), -k)

        rule = rule[: max(range(1, len(rule) + 1), key=worth)]
        p, n = (x + y for x, y in zip(_count(grow, rule), _count(prune, rule), strict=True))
        if p < least or p < precision * (p + n):
            break
        found.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return found


def list_column(rules: list[list[Condition]]) -> Column:
    """True where no rule holds: one CASE with the rules in their order."""
    case = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds &= c.column()
        case = F.when(holds, F.lit(False)) if case is None else case.when(holds, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = 8000, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, **settings) -> list[list[Condition]]:
    """Learn a decision list from at most `sample` labelled rows (those with the smallest seeded hashes), label 0 being bad.

    Rows whose crc32 of the id as text leaves 0 modulo `held_out` are never learned from. Null labels and ids are ignored; of
    repeated labels of an id the smallest counts, of repeated documents of an id the text with the smallest hash; columns of
    docs other than id and text, whatever their names, are ignored, and so are those of labels; texts of any length are
    taken whole. Empty tables give no rules.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__own"))
    fold = F.crc32(F.col("__id").cast("string").cast("binary"))
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__mark")).where(F.col("__mark").isNotNull() & F.col("__id").isNotNull() & (fold % held_out != 0)).groupBy("__id").agg(F.min("__mark").alias("__label"))
    drawn = known.orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(sample)  # at most `sample` rows
    # one text per id: bounded by the sample, and statistics are worked out for these texts only
    texts = own.join(F.broadcast(drawn), "__id").groupBy("__id", "__label").agg(F.min_by("__own", F.xxhash64("__own")).alias("__own"))
    stats = with_statistics(texts, "__own").where(~base_failed()).select("__id", "__label", *SEPARATE)
    rows = [{**{n: float(r[n]) for n in SEPARATE}, "bad": r["__label"] == 0, "fold": zlib.crc32(f"{seed}:{r['__id']}".encode()) % 3} for r in stats.collect()]
    rows.sort(key=lambda r: tuple(r.values()))
    return learn_list(rows, **settings)


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """docs with statistics, base_failed and kept: False where the base rules fail, else what the list says.

    Null, empty and blank texts have no words and fail; texts of any length are judged whole, by themselves; repeated rows
    and rows without an id stay; columns with the name of an output give way; an empty table gives no rows.
    """
    stats = with_statistics(docs, text_col).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(list_column(rules)))
