"""Problem 8: texts that were decoded with a wrong character encoding.

A multinomial classifier over hashed byte bigrams tells, for every stretch of a text that has characters beyond ASCII, whether it is rightly written or by
which chain of encodings it was garbled. It is trained on a bounded sample of the corpus itself, whose stretches are garbled here by every known chain. A
predicted chain is inverted, strictly: the result must decode without an error, and the classifier must find it rightly written.
"""

from __future__ import annotations

import codecs
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .sampling import seeded_sample


def _keep(error: UnicodeError):
    """Bytes that a code page leaves undefined stand for the control characters of the same number, as lenient decoders have it."""
    part = error.object[error.start : error.end]
    if isinstance(error, UnicodeDecodeError):
        return "".join(map(chr, part)), error.end
    if all(0x80 <= ord(c) < 0xA0 for c in part):
        return bytes(map(ord, part)), error.end
    raise error


codecs.register_error("textmill-keep", _keep)

#: Encodings, as (written in, read as).
WESTERN, CYRILLIC = ("cp1252", "mac_roman", "cp437", "cp850"), ("cp1251", "koi8_r", "cp866", "iso8859_5")
UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "iso8859_2", "cp1254", "iso8859_15", "cp1251", "koi8_r", "cp437", "cp850", "cp866", "mac_roman")
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    *((("utf-8", b),) for b in UTF8_READ_AS),
    *(((a, b),) for a in WESTERN for b in (*WESTERN, "cp1251", "cp1250", "koi8_r", "cp866") if a != b),
    *(((a, b),) for a in CYRILLIC for b in (*CYRILLIC, "cp1252", "latin_1", "mac_roman", "cp437", "cp850") if a != b),
    *((("utf-8", b), ("utf-8", b)) for b in ("cp1252", "latin_1", "cp1251", "cp437", "mac_roman")),
)
LOST = "�"
BUCKETS = 1 << 14
_STRETCH = re.compile(r"[^\n.!?]*[\n.!?]*")
_WIDE = re.compile(r"[^\x00-\x7f]+")
_ENTITY = re.compile(r"&#?\w{2,8};")


def garble(text: str, chain) -> str | None:
    """text after the chain, or None where an encoding can't hold it."""
    for written, read in chain:
        try:
            text = text.encode(written).decode(read, "textmill-keep")
        except UnicodeError:
            return None
    return text


def invert(text: str, chain) -> str | None:
    """The text before the chain, or None where that isn't strictly decodable.

    If all of it can't be inverted, as where only a part was garbled, the chains over UTF-8 are inverted run by run of wide characters, where they can be.
    """
    for written, read in reversed(chain):
        try:
            text = text.encode(read, "textmill-keep").decode(written)
            continue
        except UnicodeError:
            if written != "utf-8":
                return None

        def run(m):
            try:
                return m.group().encode(read, "textmill-keep").decode("utf-8")
            except UnicodeError:
                return m.group()

        done = _WIDE.sub(run, text)
        if done == text:
            return None
        text = done
    return text


def _buckets(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and part of every byte bigram that has a byte beyond ASCII."""
    raw = np.frombuffer("\n".join([*parts, ""]).encode("utf-8", "replace"), np.uint8)
    if len(raw) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter((len(p.encode("utf-8", "replace")) + 1 for p in parts), np.int64, len(parts))
    wide = raw > 0x7F
    at = np.flatnonzero(wide[1:] | wide[:-1])
    code = raw[at].astype(np.uint32) * np.uint32(256) + raw[at + 1]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), np.searchsorted(np.cumsum(sizes), at, side="right")


_BLANK = re.compile("[\\s\u200b\ufeff\u00ad\u2018\u2019\u201c\u201d\u2013\u2014\u2026]")
_IN_WORD = re.compile(r"[^\W\d_][^\x00-\x7f\W\d_]|[^\x00-\x7f\W\d_][^\W\d_]")
_MIXED = re.compile("[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")


def _textlike(part: str, text: str) -> bool:
    """Whether the result has wide letters within words, no word of two scripts, and the part more than a ruler of a few symbols."""
    wide = [c for c in part if c > "\x7f"]
    symbols = not any(c.isalpha() for c in wide) and not re.search("[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", part)
    return _IN_WORD.search(text) is not None and not _MIXED.search(text) and not (symbols and len(set(wide)) < 8)


def _whole(part: str, chain) -> bool:
    """Whether all of the part inverts strictly by a chain over UTF-8."""
    try:
        for written, read in reversed(chain):
            part = part.encode(read, "textmill-keep").decode(written)
    except UnicodeError:
        return False
    return chain[0][0] == "utf-8"


@dataclass
class Model:
    """Log-probabilities of buckets by class; class 0 is rightly written text, class k the k-th of `chains`."""

    chains: list
    table: np.ndarray
    prior: float

    def scores(self, parts: list[str]) -> np.ndarray:
        bucket, part = _buckets(parts)
        out = np.zeros((len(parts), self.table.shape[1]), np.float32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        for a in range(0, len(starts), 4096):  # bounded memory
            s = starts[a : a + 4096]
            end = starts[a + 4096] if a + 4096 < len(starts) else len(bucket)
            out[part[s]] = np.add.reduceat(self.table[bucket[s[0] : end]], s - s[0], axis=0)
        out[:, 0] += self.prior
        return out

    def judge(self, part: str, score: np.ndarray, margin: float, sure: float, tries: int = 4) -> tuple[object, str | None] | None:
        """(chain, original or None) if the part is garbled, else None."""
        order = np.argsort(-score)[:tries]
        if order[0] == 0 or score[order[0]] - score[0] < margin:
            return None
        bare = None
        for k in order:
            if not k or score[k] - score[0] < margin:
                break
            chain = self.chains[k - 1]
            text = invert(part, chain)
            if text is None or LOST in text or text == part:
                continue
            if chain[0][0] != "utf-8":
                # Any bytes decode by a code page, so these chains have to do without the evidence of blanks, and their result must look like text.
                if bare is None:
                    bare = self.scores([_BLANK.sub(" ", part)])[0]
                few = sum(c > "\x7f" for c in _BLANK.sub(" ", part)) < 2
                if bare[k] - bare[0] < margin * (2 + few) or not _textlike(part, text):
                    continue
            if _whole(part, chain):
                return chain, text
            again = self.scores([text])[0]
            sizes = [max(1, len(_buckets([x])[0])) for x in (part, text)]
            if text.isascii() or (again[0] >= again.max() - 2 * margin and again[0] >= score[0] + margin and (again[0] - self.prior) / sizes[1] > (score[0] - self.prior) / sizes[0] + 0.5):
                return chain, text
        # Garbled beyond doubt, but something was lost.
        chain = self.chains[order[0] - 1]
        if score[order[0]] - score[0] >= sure and any(c.isalpha() for c in part if c > "\x7f") and _textlike(part, part):
            return chain, None
        return None


def wide_parts(text: str) -> list[tuple[int, int]]:
    """Ranges of the stretches (sentences, lines) that have wide characters or named entities."""
    return [m.span() for m in _STRETCH.finditer(text) if not m.group().isascii() or ("&" in m.group() and not html.unescape(m.group()).isascii())]


def train(texts: list[str], prior: float = 3.0, rounds: int = 2, smoothing: float = 0.02) -> Model:
    """The classifier, from sampled texts that are rightly written for the most part; stretches that it finds garbled are left out in the next round."""
    parts = [t[a:b].strip() for t in texts for a, b in wide_parts(t) if LOST not in t[a:b] and not _ENTITY.search(t[a:b])]
    alphabet = sorted({c for p in parts for c in p if c > "\x7f"})
    inside = [frozenset(c for c in p if c > "\x7f") for p in parts]
    known = {chain: frozenset(c for c in alphabet if (g := garble(c, chain)) is not None) for chain in CHAINS}
    moved = {chain: frozenset(c for c in known[chain] if garble(c, chain) != c) for chain in CHAINS}
    # What strictly decodes as UTF-8 in a run of wide characters is no rightly written text.
    clean = [not any(_mends(p, b) for b in ("cp1252", "cp437", "cp1251", "mac_roman", "cp1250")) for p in parts]
    for k in range(rounds):
        if k:
            scores = model.scores(parts)
            clean = [c and model.judge(p, s, 4.0, 1e9) is None for p, s, c in zip(parts, scores, clean)]
        right = [p for p, c in zip(parts, clean) if c]
        counts, chains = [np.bincount(_buckets(right)[0], minlength=BUCKETS)], []
        for chain in CHAINS:
            # Mostly changed stretches only: a chain that leaves a language's letters alone must not stand for that language.
            good = [p for p, i, c in zip(parts, inside, clean) if c and i <= known[chain] and 3 * len(i & moved[chain]) > 2 * len(i)]
            if len(good) >= 20:
                counts.append(np.bincount(_buckets([garble("\n".join(good), chain)])[0], minlength=BUCKETS))
                chains.append(chain)
        table = np.stack(counts, 1).astype(np.float64) + smoothing
        model = Model(chains, np.log(table / table.sum(0)).astype(np.float32), prior)
    return model


def _mends(part: str, read: str) -> bool:
    for m in _WIDE.finditer(part):
        if len(m.group()) >= 2:
            try:
                m.group().encode(read, "textmill-keep").decode("utf-8")
                return True
            except UnicodeError:
                pass
    return False


def fit(docs: DataFrame, text_col: str = "text", sample: int = 2000, seed: int = 42) -> Model:
    """The classifier of a corpus, from `sample` rows with wide characters at most, taken in a seeded order."""
    wide = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]") & (F.length("text") < 20_000))
    rows = seeded_sample(wide, F.xxhash64("text", F.lit(seed)), sample, docs.count())
    return train([r[0] for r in rows])


def repair(text: str, model: Model, margin: float, sure: float, ranges=None, scores=None) -> tuple[list[str], str | None, bool]:
    """(chains found, the text with all garbled stretches restored, whether nothing was lost)."""
    ranges = wide_parts(text) if ranges is None else ranges
    plain = [html.unescape(text[a:b]) if _ENTITY.search(text[a:b]) else text[a:b] for a, b in ranges]
    scores = model.scores(plain) if scores is None else scores
    found, out, at, whole = [], [], 0, True
    for (a, b), part, score in zip(ranges, plain, scores):
        name, fixed = None, None
        if LOST in part:
            name = "lost"
        elif (got := model.judge(part, score, margin, sure)) is not None:
            name, fixed = "+".join(f"{x}>{y}" for x, y in got[0]) + ("&" if part != text[a:b] else ""), got[1]
        if name:
            found.append(name)
            whole &= fixed is not None
            out += [text[at:a], fixed if fixed is not None else text[a:b]]
            at = b
    return sorted(set(found)), "".join([*out, text[at:]]) if found else None, whole


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, margin: float = 4.0, sure: float = 25.0) -> DataFrame:
    """<id>, chains, restored: one row for each garbled text; restored is null where something was lost.

    A stretch is garbled if a chain beats rightly written text by `margin` (log-odds), can be inverted strictly and leaves text that the classifier finds rightly
    written; or if it beats it by `sure` and can't be inverted; or if it has replacement characters. Null, empty and ASCII texts give no row. Repeated rows give a row each.
    """
    model = fit(docs, text_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            ids, rows = [], []
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                block = texts[a : a + 256]
                ranges = [wide_parts(t) for t in block]
                flat = [html.unescape(t[x:y]) if "&" in t[x:y] and _ENTITY.search(t[x:y]) else t[x:y] for t, r in zip(block, ranges) for x, y in r]
                scores, at = m.scores(flat), 0
                for k, (t, r) in enumerate(zip(block, ranges)):
                    mine = scores[at : at + len(r)]
                    at += len(r)
                    if LOST in t or (len(mine) and (mine[:, 1:].max(1, initial=-np.inf) > mine[:, 0]).any()):
                        chains, restored, whole = repair(t, m, margin, sure, r, mine)
                        if chains:
                            ids.append(names[a + k])
                            rows.append((chains, restored if whole else None))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([c for c, _ in rows], pa.list_(pa.string())), pa.array([t for _, t in rows], pa.string())], names=["id", "chains", "restored"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(texts.where(F.col("text").rlike("[^\\x00-\\x7f]|&#?\\w{2,8};"))).mapInArrow(run, "id long, chains array<string>, restored string").withColumnRenamed("id", id_col)
