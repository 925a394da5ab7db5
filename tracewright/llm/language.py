"""Language identification by hierarchy: a family first, then the languages of that family by duels.

Texts become counts of hashed runs of one to three letters (white space and signs are one gap).
Languages whose average profiles resemble each other form a family; multinomial counts of the families
choose one, and within it linear support vector machines, one for each pair of languages, vote. They
are fitted on a bounded number of texts for each language: those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_runs, tidy, written

DIMENSIONS = 1 << 13
ORDERS = 3
UNKNOWN = "und"
MOST_TEXTS = 8_000  # texts that are fitted on, of all languages together
LEAST_TEXTS = 50  # of each language at least, where it has as many
PENALTY = 8.0
ROUNDS = 60
AT_ONCE = 64  # texts that are scored at once
SLICE = 1 << 20  # characters that are counted at once


@cache
def _letters():
    import numpy as np

    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str):
    """Counts of the hashed letter runs of a whole text, or None if it has no letter."""
    import numpy as np

    total = np.zeros(DIMENSIONS, np.int64)
    before = np.zeros(0, np.uint64)
    found = False
    for lo in range(0, len(text), SLICE):
        points = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        found = found or bool(letter.any())
        marks = np.where(letter, points, 32).astype(np.uint64)
        # gaps are one mark, and there is one at both ends
        marks = np.concatenate([before if lo else np.array([32], np.uint64), marks, np.array([32] if lo + SLICE >= len(text) else [], np.uint64)])
        marks = marks[np.concatenate([[True], (marks[1:] != 32) | (marks[:-1] != 32)])]
        new = len(before)  # runs that end within these were counted
        before = marks[-(ORDERS - 1) :]
        run = np.zeros(len(marks), np.uint64)
        for order in range(1, ORDERS + 1):
            run = run[: len(marks) - order + 1] * np.uint64(0x1F_FFFF + 2) + marks[order - 1 :]
            at = run * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order * 0x632BE59BD9B4E019 & ~(-1 << 64))
            at = ((at ^ (at >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 13)
            ends = np.arange(order - 1, len(marks))
            keep = ends >= new if lo else ends >= 0
            if order == 1:
                keep &= marks != 32
            total += np.bincount(at[keep].astype(np.int64), minlength=DIMENSIONS)
    return total if found else None


def _profile(c):
    """Square roots of shares: a vector of length 1."""
    import numpy as np

    return np.sqrt(c / c.sum())


def _texts(column):
    """(first row, texts) of an Arrow column in slices bounded by bytes."""
    for start, raws in byte_runs(column):
        yield start, [None if r is None else r.decode("utf-8", "replace") for r in raws]


def _features(batches):
    """lang, h, at, n: places and counts of each text that has a letter."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        langs, hashes = batch.column(0), batch.column(1)
        for start, texts in _texts(batch.column(2)):
            rows, places, numbers = [], [], []
            for i, text in enumerate(texts):
                c = counts(text or "")
                if c is not None:
                    at = np.flatnonzero(c)
                    rows.append(start + i)
                    places.append(at.astype(np.int32))
                    numbers.append(c[at].astype(np.int32))
            if rows:
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(rows)), hashes.take(pa.array(rows)), pa.array(places, pa.list_(pa.int32())), pa.array(numbers, pa.list_(pa.int32()))], ["lang", "h", "at", "n"])


def _average(key, table):
    """Counts and average profile of the texts of a language."""
    import numpy as np
    import pyarrow as pa

    total, profile = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for at, n in _sorted_rows(table):
        total[at] += n
        profile[at] += np.sqrt(n / n.sum())
    return pa.table({"lang": [key[0].as_py()], "texts": [table.num_rows], "total": [total.tobytes()], "profile": [(profile / max(1, table.num_rows)).tobytes()]})


def _sorted_rows(table) -> list[tuple]:
    """(places, counts) of the texts in the order of their hashes: sums don't hang on how rows arrived."""
    table = table.sort_by("h")
    return [(a.values.to_numpy(), n.values.to_numpy()) for a, n in zip(table.column("at"), table.column("n"), strict=True)]


def separator(rows: list[tuple], signs):
    """Weights and bias of a linear support vector machine (squared hinge loss), by coordinate descent in the dual.

    rows: (places, values) of each text. Both sides count alike, however many texts they have.
    """
    import numpy as np

    w, bias, n = np.zeros(DIMENSIONS), 0.0, len(rows)
    slack = np.array([1 / (2 * PENALTY * n / (2 * max(1, (signs == s).sum()))) for s in signs])
    own = np.array([v @ v + 1 for _, v in rows]) + slack
    alpha, order = np.zeros(n), np.random.default_rng(0)
    for _ in range(ROUNDS):
        most = 0.0
        for i in order.permutation(n):
            at, v = rows[i]
            slope = signs[i] * (w[at] @ v + bias) - 1 + slack[i] * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            most = max(most, abs(slope))
            new = max(0.0, alpha[i] - slope / own[i])
            step = (new - alpha[i]) * signs[i]
            alpha[i] = new
            w[at] += step * v
            bias += step
        if most < 0.01:
            break
    return w, bias


def _duel(key, table):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = table.sort_by("h")
    first = pc.equal(table.column("lang"), table.column("first")).to_numpy(zero_copy_only=False)
    rows = [(at, np.sqrt(n / n.sum())) for at, n in _sorted_rows(table)]
    w, bias = separator(rows, np.where(first, 1.0, -1.0))
    return pa.table({"pair": [key[0].as_py()], "w": [w.tobytes()], "bias": [bias]})


def families(profiles: Mapping[str, object]) -> dict[str, int]:
    """Families of languages: those closest by the average cosine of their profiles join while they are closer than languages are on average."""
    import numpy as np

    names = sorted(profiles)
    x = np.array([profiles[k] for k in names])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = x @ x.T
    groups = [[i] for i in range(len(names))]
    usual = near[np.triu_indices(len(names), 1)].mean() if len(names) > 1 else 1.0
    while len(groups) > 1:
        score, i, j = max((near[np.ix_(a, b)].mean(), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        if score < usual:
            break
        groups[-j] += groups.pop(-i)
    return {names[i]: k for k, g in enumerate(groups) for i in g}


class Model(NamedTuple):
    """What prediction needs; its size is set by the number of languages and pairs within families."""

    members: list[list[str]]  # languages of each family
    log_shares: object  # a row for each family
    priors: object
    duels: list[tuple[list[tuple[int, int]], object, object]]  # of each family: pairs of members, weights, biases

    def predict(self, rows: list) -> list[tuple[str, float]]:
        """Language and score of each array of counts."""
        import numpy as np

        c = np.array(rows, float)
        support = c @ self.log_shares.T + self.priors
        # a text counts as at most a hundred runs for the score, since runs hang together
        calm = support * (np.minimum(1, 100 / c.sum(1)))[:, None]
        sure = np.exp(calm - calm.max(1, keepdims=True))
        sure /= sure.sum(1, keepdims=True)
        x = np.sqrt(c / c.sum(1, keepdims=True))
        out: list = [None] * len(rows)
        chosen = support.argmax(1)
        for f in np.unique(chosen):
            at = np.flatnonzero(chosen == f)
            names, (pairs, w, bias) = self.members[f], self.duels[f]
            if not pairs:
                for i in at:
                    out[i] = (names[0], float(sure[i, f]))
                continue
            margins = x[at] @ w.T + bias
            votes, trust = np.zeros((len(at), len(names))), np.zeros((len(at), len(names)))
            for k, (a, b) in enumerate(pairs):
                won = 1 / (1 + np.exp(-np.clip(3 * margins[:, k], -50, 50)))
                votes[:, a] += margins[:, k] > 0
                votes[:, b] += margins[:, k] <= 0
                trust[:, a] += won
                trust[:, b] += 1 - won
            trust /= len(names) - 1
            best = (votes + trust / 2).argmax(1)  # equal votes: the more trusted one
            for i, j, t in zip(at, best, trust, strict=True):
                out[i] = (names[j], float(sure[i, f] * t[j]))
        return out


def learn(docs: DataFrame, most_texts: int = MOST_TEXTS, family_of: Mapping[str, int] | None = None) -> Model | None:
    """Model of the languages of docs (text, lang), or None if no row has both and a letter.

    Each language gives its distinct texts of smallest hash: an even share of most_texts, but at least
    LEAST_TEXTS. Copies thus count once, and a language with many rows weighs no more than others.
    family_of: families, where they are to be given instead of found. The driver holds 128 KB for each
    language and 64 KB for each pair within a family.
    """
    import numpy as np

    spark = docs.sparkSession
    labelled = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64("text").alias("h"), "text")
    names = labelled.select("lang", "h").distinct()
    each = max(LEAST_TEXTS, most_texts // max(1, labelled.select("lang").distinct().count()))
    # the smallest hashes of each language come from each task's smallest ones
    ranked = names.selectExpr("lang", "h", "row_number() OVER (PARTITION BY lang ORDER BY h) AS place").filter(F.col("place") <= each)
    limits = ranked.groupBy("lang").agg(F.max("h").alias("limit"))
    limits = spark.createDataFrame(limits.collect(), "lang string, limit long")  # a row for each language
    taken = labelled.join(F.broadcast(limits), "lang").filter("h <= limit").select("lang", "h", "text").dropDuplicates(["lang", "h"])
    features = written(taken.mapInArrow(tidy(_features), "lang string, h long, at array<int>, n array<int>"), "language-features")
    found = features.groupBy("lang").applyInArrow(_average, "lang string, texts long, total binary, profile binary").collect()
    if not found:
        return None
    total = {r.lang: np.frombuffer(r.total) for r in found}
    family_of = family_of or families({r.lang: np.frombuffer(r.profile) for r in found})
    members: dict = {}
    for lang in sorted(total):
        members.setdefault(family_of.get(lang, lang), []).append(lang)
    groups = [members[k] for k in sorted(members, key=str)]
    shares = np.array([sum(total[k] / total[k].sum() for k in g) / len(g) for g in groups])
    log_shares = np.log(shares + 0.01 / DIMENSIONS) - np.log(1.01)
    pairs = [(f, a, b) for f, g in enumerate(groups) for a in range(len(g)) for b in range(a)]
    duels = {}
    if pairs:
        sides = [(k, groups[f][a], groups[f][i]) for k, (f, a, b) in enumerate(pairs) for i in (a, b)]
        fights = features.join(F.broadcast(spark.createDataFrame(sides, "pair long, first string, lang string")), "lang")
        for r in fights.groupBy("pair").applyInArrow(_duel, "pair long, w binary, bias double").collect():
            duels[r.pair] = (np.frombuffer(r.w), r.bias)
    by_family = []
    for f in range(len(groups)):
        of = [(k, (a, b)) for k, (g, a, b) in enumerate(pairs) if g == f]
        by_family.append(([p for _, p in of], np.array([duels[k][0] for k, _ in of]), np.array([duels[k][1] for k, _ in of])))
    return Model(groups, log_shares, np.zeros(len(groups)), by_family)


def _predicted(shared):
    def run(batches: Iterable):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for start, texts in _texts(batch.column(at)):
                for lo in range(0, len(texts), AT_ONCE):
                    part = [counts(t or "") for t in texts[lo : lo + AT_ONCE]]
                    known = [c for c in part if c is not None]
                    told = iter(model.predict(known) if known and model else [])
                    answers = [(UNKNOWN, 0.0) if c is None or not model else next(told) for c in part]
                    rows = batch.slice(start + lo, len(part))
                    yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(rows.columns) if k != at], pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())], [*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])

    return tidy(run)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of docs without text, and lang_pred and score; only text is looked at.

    Texts that are null or have no letter, and all texts without a model, are UNKNOWN with score 0.
    Whole texts are counted, of any length.
    """
    rest = [f for f in docs.schema if f.name != "text"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return docs.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), f"{schema}lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning; one without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, by a model of the rows that aren't held out.

    docs: doc_id, text, lang; other columns are ignored. Rows without an id are neither held out nor
    learned from. Repeated rows keep their rows, equal texts have equal answers, an empty table gives
    none; without any labelled text all are UNKNOWN.
    """
    model = learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"), most_texts)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
