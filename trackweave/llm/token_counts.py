"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi search.

A stretch of text that no vocabulary piece can leave (from one space mark to the next)
is segmented on its own: an Aho-Corasick automaton names all pieces that end at each
character, and dynamic programming carries the best score and its number of pieces.
Ties go as in the tokenizer: of equal scores, the path whose last piece is longest.
Stretches repeat, so each worker keeps the counts of those it has met. Sums of whole
numbers are exact. Of others, the tokenizer's sum to the front of a stretch can round a close
decision either way: where two paths of unlike counts come closer than any rounding, the
stretch is done again from that very sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackweave.llm.common import map_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Two sums of a stretch's scores that differ by less than this share of what they could be at most may be equal but for rounding.
ROUNDING = 1e-8
#: Stretches that a worker remembers; older ones are computed anew.
MEMORY = 400_000


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file; control pieces keep their places."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of a text as the unigram tokenizer over `pieces` with byte fallback does."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0):
        scores = [s for _, s in pieces]
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            raise ValueError("a piece holds a space mark after other characters")
        self.whole = all(s == int(s) for s in scores)
        self.unknown = min(scores) - UNKNOWN_PENALTY
        known = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.machine = ahocorasick.Automaton()
        for p, s in {p: s for p, s in pieces}.items():
            if p:
                self.machine.add_word(p, (len(p), s))
        self.machine.make_automaton()
        self.most = max(map(abs, [*scores, self.unknown]))
        self.seen: dict[str, tuple] = {}

    def stretch(self, text: str, base: float = 0.0) -> tuple[int, float, bool, list[float]]:
        """Number of pieces and best score from a sum of `base` on, whether another sum could change the number, and the scores of the pieces in turn (the last two for scores that aren't whole)."""
        n, whole = len(text), self.whole
        score, count, gap, back = [base] * (n + 1), [0] * (n + 1), [False] * (n + 1), [(0, 0.0)] * (n + 1)
        at, best, pieces, single, source = 0, None, 0, False, (0, 0.0)  # of the paths to the end of character `at`
        rivals, near, unsure = [], ROUNDING * (self.most * (n + 1)), False

        def close(upto: int) -> None:
            nonlocal at, best, pieces, single, source, unsure
            while at < upto:
                if not single:
                    made, fresh = score[at] + self.unknown, len(text[at].encode()) if self.bytes else 0 if gap[at] else 1
                    if not whole:
                        rivals.append((made, count[at] + fresh, True))
                    if best is None or made > best:
                        best, gap[at + 1], source = made, True, (at, self.unknown)
                        pieces = count[at] + fresh
                if not whole:
                    unsure = unsure or any(best - r < near and (c, g) != (pieces, gap[at + 1]) for r, c, g in rivals)
                    rivals.clear()
                at += 1
                score[at], count[at], back[at], best, single = best, pieces, source, None, False

        for end, (length, s) in self.machine.iter(text):  # of those with one end the longest first: a later equal score doesn't replace it
            if end > at:
                close(end)
            single |= length == 1
            made = score[end + 1 - length] + s
            if not whole:
                rivals.append((made, count[end + 1 - length] + 1, False))
            if best is None or made > best:
                best, pieces, source = made, count[end + 1 - length] + 1, (end + 1 - length, s)
        close(n)
        steps = []
        while n and not whole:
            n, s = back[n]
            steps.append(s)
        return count[-1], score[-1], unsure, steps[::-1]

    def __call__(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts, seen, total, score, blank, before = (SPACE + text.replace(" ", SPACE)).split(SPACE)[1:], self.seen, 0, 0.0, 0, []
        for part in [*parts, None]:  # empty parts are further space marks before the next one
            if part == "" or part is None and not blank:
                blank += 1
                continue
            key = SPACE * (blank - 1) if part is None else SPACE * blank + part if blank else part
            blank = 0
            if (made := seen.get(key)) is None:
                if len(seen) >= MEMORY:
                    seen.clear()
                made = self.stretch(SPACE + key)
                if len(key) <= 64:
                    seen[key] = made
            if not self.whole:
                if made[2]:
                    made = self.stretch(SPACE + key, in_turn(before))
                before.append(made[3])
            total += made[0]
            score += made[1]
        return total, score if self.whole else in_turn(before)


def in_turn(steps: list[list[float]]) -> float:
    """The sum as it comes from adding one after the other."""
    total = 0.0
    for own in steps:
        for s in own:
            total += s
    return total


@lru_cache(maxsize=4)
def counter(model_file: str) -> Counter:
    return Counter(vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Columns `keep` (doc_id) with n_tokens and viterbi_score of each whole text.

    Null and empty texts have no tokens and score 0; repeated rows are counted each; of an
    empty table nothing comes. Text is taken as it is but for spaces, which become space
    marks, one more in front.
    """

    def run(rows: list[bytes]) -> list:
        count = counter(model_file)
        made = [count(t.decode()) for t in rows]
        return [np.array([n for n, _ in made], np.int64), np.array([s for _, s in made], np.float64)]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("viterbi_score", T.DoubleType())]
    return map_text(docs, text_col, fields, run, ["doc_id"] if keep is None else keep)


def reference_counts(texts: Iterator[str], model_file: str) -> list[int]:
    """The same counts from the tokenizer library itself."""
    from tokenizers import Tokenizer, models, normalizers

    whole = Tokenizer(models.Unigram(vocabulary(model_file), unk_id=0, byte_fallback=True))
    whole.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    return [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]
