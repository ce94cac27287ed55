"""Splitting oversized texts at natural boundaries.

The cuts are chosen with a sparse table over boundary strengths: the strongest cut in the permissible length window is a
range-maximum query answered from two table entries, ties go to the right, and the next piece starts `overlap` tokens before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.llm.tokens import default_path, encoding

#: Strength of a cut, from the strongest.
PARAGRAPH, SENTENCE, LINE, WORD, INSIDE = 4, 3, 2, 1, 0
KINDS = ["inside", "word", "line", "sentence", "paragraph"]
#: A blank line, a line of marks only, or a line that starts with an indent: the text after it is a new paragraph.
_PARAGRAPH = re.compile(r"\n[ \t]*(?:[^\w\n]*\n)+[ \t]*|\n(?:[ \t]{2,}|\t)(?=\S)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'»“)\]]*\s+(?=[\W_]*[A-ZÄÖÜÉÈÀÂÊÎÔÛÇ0-9])")
#: A line end counts only if no word is broken over it.
_LINE = re.compile(r"(?<![-¬=\s])[ \t]*\n[ \t]*")
_WORD = re.compile(r"(?<=\S)\s+")


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character (and after the last)."""
    out = np.zeros(len(text) + 1, dtype=np.int8)
    for pattern, value in ((_WORD, WORD), (_LINE, LINE), (_SENTENCE, SENTENCE), (_PARAGRAPH, PARAGRAPH)):
        # a cut falls before the blanks' last line break or blank, which starts the next piece's first token, and after them
        at = [p for m in pattern.finditer(text) for p in (m.start(), m.end() - 1, m.end()) if p > m.start() or text[p : p + 1].isspace()]
        if at:
            np.maximum.at(out, np.array(at), np.int8(value))
    return out


class RangeMax:
    """Sparse table: the largest value in a range of at most `widest` values in constant time."""

    def __init__(self, values: np.ndarray, widest: int | None = None):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= min(len(values), widest or len(values)):
            a = self.levels[-1]
            self.levels.append(np.maximum(a[:-half], a[half:]))

    def query(self, lo: int, hi: int) -> int:
        """Of the values at lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        return int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))


def split_text(text: str, limit: int, overlap: int, enc, fill: float = 0.5) -> list[tuple[int, int, int, int, str]]:
    """Pieces of a text as (first token, token after the last, first char, char after the last, kind of cut).

    One piece if the text has at most `limit` tokens.  A piece has at least `fill` of the limit, unless it is the last, and
    never more tokens than the limit, neither as a slice of the page's tokens nor tokenised on its own.  Where the least piece after an overlap has more,
    the overlap is shortened; where the least piece without one has, which takes a limit of a few tokens, it's an error.
    """
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= limit:
        return [(0, n, 0, len(text), "end")]
    lengths = np.fromiter((len(x) for x in enc.decode_tokens_bytes(ids)), dtype=np.int64, count=n)
    byte = np.concatenate([[0], np.cumsum(lengths)])
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)  # bytes where a character begins
    char = np.cumsum(starts) - 1  # byte -> character
    whole = starts[byte]
    at = char[byte]
    strength = np.where(whole, strengths(text)[at], -1).astype(np.int64)
    best = RangeMax(strength * (n + 1) + np.arange(n + 1), limit + 1)
    out, start = [], 0
    while True:
        most = limit
        while True:
            if n - start <= most:
                end, kind = n, "end"
            else:
                key = best.query(start + max(overlap + 1, int(most * fill)), start + most)
                end, kind = key % (n + 1), KINDS[max(0, key // (n + 1))]
            # the slice's own tokens can differ at its edges
            if len(enc.encode_ordinary(text[at[start] : at[end]])) <= limit:
                break
            if most > overlap + 2:
                most -= 1 + (most > limit // 2)
            elif out and start < out[-1][1]:  # it can't keep the whole overlap
                start, most = next(k for k in range(start + 1, out[-1][1] + 1) if whole[k]), limit
            else:
                raise ValueError("a piece of the least size has more tokens by itself than the limit")
        out.append((start, end, int(at[start]), int(at[end]), kind))
        if end == n:
            return out
        back = end - overlap
        while back > start + 1 and not whole[back]:
            back -= 1
        start = back


def split_documents(documents: DataFrame, limits: DataFrame, *, tokenizer: str | None = None, fill: float = 0.5, default_lang: str = "en", doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Pieces of all texts over their language's limit: doc_id, piece_no (from 0), first_token, end_token, first_char,
    end_char (the piece is text[first_char:end_char]), n_tokens, overlap_tokens (shared with the piece before, 0 for the first), cut
    (what ends it: paragraph, sentence, line, word, inside, or end), text.

    Consecutive pieces share overlap_tokens tokens of the page's tokenisation (one to three more where the step back would cut
    a character of several tokens).  Together the pieces cover the text.  Texts within the limit, null and empty texts give no rows.
    Null languages, and such as limits doesn't list, follow `default_lang`.  limits has one row per language and is small (it's checked).

    One pass over the documents without a shuffle: a text no longer in bytes than its limit has no more tokens than that and is
    passed over before it reaches Python.
    """
    rows = limits.limit(1001).collect()
    table = {r.lang: (int(r.max_tokens), int(r.overlap_tokens)) for r in rows}
    if len(rows) > 1000 or len(table) < len(rows) or default_lang not in table:
        raise ValueError("limits need one row per language, at most 1000, and the default language")
    if any(not 0 <= o < m * fill - 1 for m, o in table.values()):
        raise ValueError("overlap_tokens must be less than the least size of a piece")
    path = tokenizer or default_path()
    known = F.create_map(*[F.lit(x) for k, (m, _) in table.items() for x in (k, m)])
    long = documents.select(F.col(doc_id).alias("doc_id"), F.when(F.col(lang).isin(list(table)), F.col(lang)).otherwise(default_lang).alias("lang"), F.col(text).alias("t"))
    long = long.where(F.octet_length("t") > F.element_at(known, F.col("lang")))
    schema = f"doc_id {documents.schema[doc_id].dataType.simpleString()}, piece_no int, first_token int, end_token int, first_char int, end_char int, n_tokens int, overlap_tokens int, cut string, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            out = []
            for d, la, t in zip(b["doc_id"], b["lang"], b["t"]):
                cuts = split_text(t, *table[la], enc, fill)
                if len(cuts) > 1:
                    out += [(d, k, f, e, c, z, e - f, cuts[k - 1][1] - f if k else 0, kind, t[c:z]) for k, (f, e, c, z, kind) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=names)

    return long.mapInPandas(pieces, schema)
