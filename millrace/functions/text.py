"""Text functions: normalisation, fingerprints, shingles, chunks, language."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def normalize(text: str) -> str:
    """NFKC, lower case, white space collapsed and trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


#: What SQL trims: the space separators of Unicode.
_SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


def normalize_column(text: Column) -> Column:
    """`normalize` but for NFKC, in the JVM and as the SQL twins have it: letters lowered one by one, whatever stands beside them,
    runs of ASCII white space without the vertical tab collapsed, space separators trimmed. Letters of Unicode 16 are lowered here, not in DuckDB 2.0."""
    alone = F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3"))
    return F.btrim(F.regexp_replace(F.lower(alone), r"[\t\n\f\r ]+", " "), F.lit(_SPACES))


def hash_exact(text: Column) -> Column:
    return F.sha2(text, 256)


class _Bits:
    """MD5 bits of words, one row each, remembered per Python worker up to a bound."""

    def __init__(self, limit: int = 1 << 18):
        self.limit, self.rows, self.bits = limit, {}, np.zeros((0, BITS), dtype=np.int8)

    def ids(self, tokens: list[str]) -> np.ndarray:
        """The row of each token."""
        if len(self.rows) > self.limit:
            self.__init__(self.limit)
        new = [t for t in dict.fromkeys(tokens) if t not in self.rows]
        if new:
            raw = b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[: BITS // 8] for t in new)
            add = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(len(new), -1), axis=1).astype(np.int8) * 2 - 1
            self.rows.update(zip(new, range(len(self.bits), len(self.bits) + len(new))))
            self.bits = np.concatenate([self.bits, add])
        return np.fromiter(map(self.rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))


_BITS, _STEP = _Bits(), 1 << 16


def _votes(tokens: list[str], ends: list[int]) -> np.ndarray:
    """Per text, whose tokens end at `ends`, and bit: words with it less words without."""
    total = np.zeros((len(ends), BITS), dtype=np.int32)
    if tokens:
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        some = np.array(ends) > starts
        ids = _BITS.ids(tokens)  # may make the rows
        total[some] = np.add.reduceat(_BITS.bits[ids], starts[some], axis=0, dtype=np.int32)
    return total


def simhash_votes(texts: Sequence[str | None]) -> np.ndarray:
    """Per text and bit of its SimHash, words with the bit set less words without. Nulls have no words."""
    out, waiting, sizes, first = np.zeros((len(texts), BITS), dtype=np.int32), [], [], 0

    def flush(upto: int) -> None:
        if sizes:
            out[first:upto] = _votes(waiting, np.cumsum(sizes).tolist())
            waiting.clear()
            sizes.clear()

    for k, t in enumerate(texts):
        tokens = [w for w in (t or "").split(" ") if w]
        if len(tokens) > _STEP:  # a very long text alone, in pieces
            flush(k)
            out[k] = sum(_votes(tokens[i : i + _STEP], [len(tokens[i : i + _STEP])]) for i in range(0, len(tokens), _STEP))[0]
            first = k + 1
            continue
        waiting += tokens
        sizes.append(len(tokens))
        if len(waiting) >= _STEP:
            flush(k + 1)
            first = k + 1
    flush(len(texts))
    return out


def simhashes(texts: Sequence[str | None]) -> np.ndarray:
    """64-bit SimHash over words as signed integers: bit k is set where more words' MD5 have bit k set than not. Nulls give 0."""
    return np.packbits(simhash_votes(texts) > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def simhash(text: str | None) -> int | None:
    """`simhashes` of one text."""
    return None if text is None else int(simhashes([text])[0])


def simhash_array(texts: list[str | None]) -> pa.Array:
    return pa.array(simhashes(texts), mask=np.array([t is None for t in texts], dtype=bool))


def simhash_column(text: Column) -> Column:
    """`simhash` of a text column."""

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([simhash_array(part.to_pylist()) for part in slices(column)])

    return F.arrow_udf(run, returnType="long")(text)


def simhash_nfkc_column(text: Column) -> Column:
    """`simhash` of `normalize` of a text column."""

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([simhash_array([None if t is None else normalize(t) for t in part.to_pylist()]) for part in slices(column)])

    return F.arrow_udf(run, returnType="long")(text)


def slices(column: pa.Array, size: int = 4 << 20) -> list[pa.Array]:
    """A column of texts in pieces of about `size` bytes, or one text: Python strings of a piece are held at once, not those of a batch."""
    if not len(column):
        return [column]
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(column)]
    return [column.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def normalize_nfkc_column(text: Column) -> Column:
    """`normalize` of a text column, NFKC included."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize(t) for t in column.to_pylist()], type=pa.string())

    return F.arrow_udf(run, returnType="string")(text)


def count_tokens_column(text: Column, tokenizer: str) -> Column:
    """Number of tokens by a tokenizer file of the tokenizers library, loaded once per batch."""

    def run(column: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        encoded = Tokenizer.from_file(tokenizer).encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)
        return pa.array([None if not v.is_valid else len(e.ids) for v, e in zip(column, encoded)], type=pa.int64())

    return F.arrow_udf(run, returnType="long")(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def shingles(text: Column, n: int) -> Column:
    """n-word shingles of a text; fewer words give none. The shifted word lists are zipped, so that words are split once, not once per shingle."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    k = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), k)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(words, F.lit(i + 1), k), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


_BOUNDARIES = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def chunk(text: str | None, least: int, most: int) -> list[str] | None:
    """Pieces of `least` to `most` characters cut at paragraph, line, sentence or word ends, whichever is the strongest in reach; together they are the text."""
    if text is None:
        return None
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        for b in _BOUNDARIES:
            ends = [m.end() for m in b.finditer(text, at + max(least, 1) - 1, at + most) if at + least <= m.end() <= at + most]
            if ends:
                cut = ends[-1]
                break
        out.append(text[at:cut])
        at = cut
    if at < len(text) or not out:
        out.append(text[at:])
    return out


_COMMON = {
    "english": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know",
    "german": "der die das und ist in zu den von mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können ich wir ihr du kann schon alle dem",
    "french": "le la les de des du un une et est en que qui dans pour pas sur au avec par il elle ce plus ne se sont son sa ses mais comme ou nous vous ils elles être avoir fait tout on cette aux leur bien aussi été même sans peut entre après y deux très était je tu",
    "spanish": "el la los las de del y en que es un una por con no para su al se lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso ante ellos e esto mí antes algunos qué unos yo otro él tanto esa estos mucho",
    "polish": "i w na nie się z do to że jest o jak za po co tak od przez ale dla już tylko być był może kto czy jego jej ich ten ta te są było będzie który która które tego tym roku przed bardzo więc gdy oraz także pod nad ma mnie mi mu ja ty my wy oni kiedy gdzie światową serię wygrał",
    "italian": "il lo la i gli le di del della e è in che un una per con non si da al come più ma sono anche nel alla questo essere ha dei o se ci io suo dal sua su quando molto ed tra stato",
    "portuguese": "o a os as de do da e em que é um uma por com não para se na no dos das mais como mas foi ao ele ela são também muito seu sua ou quando já nos eu isso pelo pela até",
    "dutch": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar door over ze hij wordt deze kan meer dit wat worden was heeft je ik we",
}
_LETTERS = {"german": "äöüß", "french": "éèêàçùœ", "spanish": "ñáíóúü¿¡", "polish": "ąćęłńśźż", "portuguese": "ãõáâêç", "italian": "àèìòù", "english": "", "dutch": ""}
_SETS = {k: frozenset(v.split()) for k, v in _COMMON.items()}


def language_scores(text: str, candidates: list[str]) -> dict[str, float]:
    """Confidence of each known candidate, together 1: evidence from frequent words and letters of their own."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    letters = set(text.lower())
    known = [c for c in dict.fromkeys(x.lower() for x in candidates) if c in _SETS]
    if not known:
        return {}
    points = np.array([sum(w in _SETS[c] for w in words) * 2.0 + 1.5 * len(letters & set(_LETTERS[c])) for c in known])
    e = np.exp(points - points.max())
    return dict(zip(known, (e / e.sum()).tolist()))
