"""Quality rules from tokeniser fertility: how well public vocabularies fit a text.

Each word is encoded on its own by two vocabularies: one of subword pieces with byte fallback, and
one of bytes for many languages. Of a text this gives the characters per token of either, the share
of tokens that are single fallback bytes, and the entropy of its pieces, which grows with their
number. Text in its language, or its script, lies within bands of these at every length; symbol
noise, encoded data and endless repetition lie outside.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, byte_runs, held, pick, small_batches, tidy
from .words import HashTable, code_points, repeated_words, split


@dataclass(frozen=True)
class Band:
    """A text is rejected below min_chars or above max_chars a piece, outside byte_chars a token of the byte vocabulary,
    above max_fallback, or below the entropy floor.

    floor: (log2 of the number of pieces, least bits of entropy), linear in between, level outside.
    """

    min_chars: float
    max_chars: float
    byte_chars: tuple[float, float]
    max_fallback: float
    floor: tuple[tuple[float, float], ...]


#: The floors lie below every document labelled good at the sizes looked at, the symbol noise and the repetition below them.
_FLOOR = ((4.3, 3.0), (5.5, 4.0), (6.5, 5.05), (7.5, 5.4), (8.5, 5.8), (9.5, 6.05), (10.5, 6.27), (11.5, 6.4), (12.5, 6.48))
_EN = ((4.3, 3.0), (5.5, 4.0), (6.5, 5.05), (7.5, 5.5), (8.5, 5.88), (9.5, 6.2), (10.5, 6.45), (11.5, 6.62), (12.5, 6.7))
#: For scripts without labelled documents: well below what plain sentences have.
_LOW = ((4.3, 2.8), (6.5, 4.2), (12.5, 5.0))
LATIN, OTHER = "latin", "other"
#: By language, and by script for texts without a listed language.
BANDS: dict[str, Band] = {
    "en": Band(1.5, 5.0, (1.6, 6.0), 0.05, _EN),
    "fr": Band(1.4, 5.0, (1.5, 6.0), 0.05, _FLOOR),
    "de": Band(1.4, 5.0, (1.5, 6.0), 0.05, _FLOOR),
    "es": Band(1.4, 5.0, (1.5, 6.0), 0.05, _FLOOR),
    LATIN: Band(1.4, 5.0, (1.5, 6.0), 0.05, _FLOOR),
    "cyrillic": Band(1.2, 5.0, (1.1, 5.0), 0.1, _LOW),
    "greek": Band(0.6, 3.0, (1.0, 4.0), 0.2, _LOW),
    "hebrew": Band(0.6, 3.0, (1.0, 4.0), 0.2, _LOW),
    "arabic": Band(0.6, 3.0, (1.0, 4.0), 0.2, _LOW),
    "indic": Band(0.5, 2.5, (0.55, 3.0), 0.4, _LOW),
    "thai": Band(0.5, 2.5, (0.55, 3.0), 0.4, _LOW),
    "han": Band(0.4, 2.5, (0.6, 3.0), 0.6, _LOW),
    "kana": Band(0.4, 2.5, (0.6, 3.0), 0.6, _LOW),
    "hangul": Band(0.4, 2.5, (0.6, 3.0), 0.6, _LOW),
    OTHER: Band(0.3, 8.0, (0.3, 8.0), 0.6, ((6.5, 3.0), (12.5, 4.0))),
}
# First code points of ranges of letters, each up to the next one.
SCRIPTS = ((0x0000, LATIN), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, OTHER), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, OTHER), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, OTHER), (0x1100, "hangul"), (0x1200, OTHER), (0x1E00, LATIN), (0x1F00, "greek"), (0x2000, OTHER), (0x3040, "kana"), (0x3100, OTHER), (0x3400, "han"), (0xA000, OTHER), (0xAC00, "hangul"), (0xD7B0, OTHER), (0xF900, "han"), (0xFB00, OTHER), (0x20000, "han"), (0x30000, OTHER))
_STARTS, _NAMES = np.array([x for x, _ in SCRIPTS]), [x for _, x in SCRIPTS]

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))


class FertilityTable(HashTable):
    """Words with their hashes, their pieces, and their numbers of tokens in the byte vocabulary."""

    def __init__(self, model: str, ranks: str, pattern: str, most: int = 64 << 20):
        import sentencepiece

        from .lengths import _encoding

        self.bytes = _encoding(ranks, pattern)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.n_ids = self.sp.get_piece_size()
        self.fallback = np.array([self.sp.is_byte(i) for i in range(self.n_ids)])
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.size = np.zeros(1 << 12, np.int64)
        self.start = np.zeros(1 << 12, np.int64)
        self.byte_size = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.int32)
        self.used = 0

    def describe(self, first: int, words: list[bytes]) -> None:
        super().describe(first, words)
        n, k = first, len(words)
        texts = [w.decode("utf-8") for w in words]
        lists = self.sp.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, k)
        total = int(sizes.sum())
        for name in ("size", "start", "byte_size"):
            while n + k > len(getattr(self, name)):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = np.fromiter((t for ids in lists for t in ids), np.int32, total)
        self.size[n : n + k] = sizes
        self.byte_size[n : n + k] = np.fromiter(map(len, map(self.bytes.encode_ordinary, texts)), np.int64, k)
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def tokens(self, slots: np.ndarray) -> np.ndarray:
        size = self.size[slots]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[slots] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def fertility_table(model: str, ranks: str, pattern: str) -> FertilityTable:
    return held(("fertility", model, ranks, pattern), lambda: FertilityTable(model, ranks, pattern))


def entropy_bits(counts: np.ndarray) -> float:
    """Entropy of token counts in bits; 0 for fewer than two tokens."""
    total = int(counts.sum())
    if total < 2:
        return 0.0
    p = counts[counts > 0] / total
    return float(-(p * np.log2(p)).sum())


def duplicate_lines(data: bytes) -> int:
    lines = data.split(b"\n")
    if len(lines) < 2:
        return 0
    filled = [x for x in lines if x.strip(BLANKS)]
    return len(filled) - len(set(filled))


def judge(band: Band, n_tokens: int, chars: float, byte_chars: float, fallback: float, entropy: float) -> bool:
    """False: rejected."""
    at, bits = zip(*band.floor, strict=True)
    low, high = band.byte_chars
    return band.min_chars <= chars <= band.max_chars and low <= byte_chars <= high and fallback <= band.max_fallback and entropy >= float(np.interp(np.log2(max(n_tokens, 1)), at, bits))


def script_of(data: bytes) -> str:
    """The script of most of a text's letters; digits and signs of the first 64 code points don't count."""
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    counts = np.bincount(np.searchsorted(_STARTS, points[points > 0x40], "right") - 1, minlength=len(_NAMES))
    totals = {n: int(counts[[i for i, x in enumerate(_NAMES) if x == n]].sum()) for n in _NAMES}
    return max(totals, key=totals.__getitem__) if len(points) else OTHER


def band_of(bands: dict[str, Band], lang: str | None, data: bytes) -> Band:
    """The band of the language, whatever its case and region; of a text without a listed language, that of its script."""
    code = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    if code in bands:
        return bands[code]
    script = script_of(data)
    return bands[script] if script in bands else bands[OTHER]


def measure(docs: DataFrame, model: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bands: dict[str, Band] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs, in one pass without a shuffle.

    Returns id_col, the columns `keep` of docs, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, n_tokens (long), chars_per_token, chars_per_byte_token,
    fallback_share, token_entropy (double), kept. model: a subword model with byte fallback; ranks and
    pattern: the byte vocabulary. Null text: as the empty text, zero in all counts, base_failed. Very
    long texts are measured whole. Null or unlisted language: the band of the text's script. Null ids
    and repeated rows are kept as they are; empty table: no rows; columns of docs not named are not
    read. bands must hold OTHER.
    """
    small_batches(docs.sparkSession)
    bands = BANDS if bands is None else bands
    types = dict(docs.dtypes)
    carried = [id_col, *keep]
    schema = ", ".join(f"c{i} {types[c]}" for i, c in enumerate(carried))
    schema += ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, token_entropy double, kept boolean"
    names = [f"c{i}" for i in range(len(carried))]

    def row(table: FertilityTable, data: bytes, lang: str | None) -> tuple:
        words = split(data)
        n = len(words)
        slots = table.slots(words)
        chars = code_points(data)
        repeat = repeated_words(table.hashes[slots], 8)
        tokens = table.tokens(slots)
        counts = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
        n_tokens = len(tokens)
        per = chars / n_tokens if n_tokens else 0.0
        n_bytes = int(table.byte_size[slots].sum())
        per_byte = chars / n_bytes if n_bytes else 0.0
        fallback = float(counts[table.fallback[: len(counts)]].sum()) / n_tokens if n_tokens else 0.0
        entropy = entropy_bits(counts)
        failed = n < 20 or 100 * repeat > 30 * n
        kept = not failed and judge(band_of(bands, lang, data), n_tokens, per, per_byte, fallback, entropy)
        return n, chars, len(data.translate(None, _NOT_SYMBOLS)), duplicate_lines(data), repeat, failed, n_tokens, per, per_byte, fallback, entropy, kept

    def run(batches):
        import pyarrow as pa

        table = fertility_table(model, ranks, pattern)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64()] + [pa.float64()] * 4 + [pa.bool_()]
        labels = names + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_tokens", "chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy", "kept"]
        for batch in batches:
            langs = batch.column(len(carried) + 1).to_pylist()
            rows = [row(table, data or b"", langs[at + i]) for at, texts in byte_runs(batch.column(len(carried))) for i, data in enumerate(texts)]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *cols], names=labels)

    out = pick(docs, *carried, text_col, lang_col).toDF(*names, "t", "l").mapInArrow(tidy(run), schema)
    return out.toDF(*carried, *out.columns[len(carried) :])


def select_kept(docs: DataFrame, model: str, ranks: str, pattern: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, lang and others, all returned) that measure() keeps.

    Rows with null or empty text go; null ids and repeated rows are judged each; columns of any name
    are carried; an empty table gives none.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    out = measure(docs.toDF(*names), model, ranks, pattern, at["doc_id"], at["text"], at["lang"], bands, keep=tuple(n for n in names if n != at["doc_id"]))
    return out.filter("kept").select(*[F.col(at[c]).alias(c) for c in docs.columns])
