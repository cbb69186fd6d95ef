"""Token counts with a whole-token shortcut for a BPE model of pieces.

Offline, once per worker: a vocabulary string is a *whole token* if the library encodes it alone as one
piece. A text is cut into pre-tokens at places no piece of the vocabulary can span, which is checked
over the whole vocabulary: before a blank that follows another character, and around characters that
occur in no piece of two or more characters (line ends, for instance). A pre-token that is a whole
token counts one; the library merges the rest, each distinct one once per worker while it is remembered.

Defined results: a null or empty text has no tokens and no bytes; special strings inside texts are ordinary
text, as the library treats them by default. Added columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re

import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexframe.llm.common import add_columns, remembered

SPACE = "▁"
LIMIT = 4096
REMEMBERED = 500_000
LONG_PRE_TOKEN = 64


class TokenCounter:
    """Counts the tokens of a text exactly as ``SentencePieceProcessor.encode`` would."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.remembered = remembered
        pieces = [
            self.library.id_to_piece(i) for i in range(self.library.get_piece_size())
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))
        ]
        self.safe = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) and self._plain()
        joined = {c for p in pieces if len(p) > 1 for c in p}
        # a pre-token: blanks and what follows them, cut at line ends when no piece holds one
        ends = "".join(re.escape(c) for c in "\n\r\t" if c not in joined)
        self.cut = re.compile(f"[{ends}]|{SPACE}*[^{SPACE}{ends}]+|{SPACE}+") if ends else re.compile(
            f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.whole = self._prove(pieces)
        self.merged: dict[str, int] = {}

    def _plain(self) -> bool:
        """The model keeps text as it is, but for a leading blank and blanks written as pieces."""
        tries = ["a", " a", "a  b ", "\tA\n", "ﬁéé", "  "]
        return all(
            "".join(self.library.encode(t, out_type=str)).replace("<0x09>", "\t").replace("<0x0A>", "\n")
            .replace("<0xEF><0xAC><0x81>", "ﬁ").replace("<0xCC><0x81>", "́")
            == SPACE + t.replace(" ", SPACE) for t in tries
        )

    def _prove(self, pieces: list[str]) -> set[str]:
        """Vocabulary strings that encode alone, after a leading blank or as a continuation, as one token."""
        return {p for p in pieces if self._alone(p) == 1}

    def _alone(self, pre_token: str) -> int:
        # the library puts a blank in front; give it away where the pre-token brings its own
        if pre_token.startswith(SPACE):
            return len(self.library.encode(pre_token[1:].replace(SPACE, " "))) if len(pre_token) > 1 else 1
        # without a blank of its own the pre-token follows a line end, which never merges
        return len(self.library.encode("\n" + pre_token)) - self._line_end

    @property
    def _line_end(self) -> int:
        if not hasattr(self, "_ends"):
            self._ends = len(self.library.encode("\n"))
        return self._ends

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.safe:
            return len(self.library.encode(text))
        total, whole, merged = 0, self.whole, self.merged
        for pre_token in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            if pre_token in whole:
                total += 1
                continue
            n = merged.get(pre_token)
            if n is None:
                n = self._alone(pre_token)
                if len(pre_token) <= LONG_PRE_TOKEN:
                    if len(merged) >= self.remembered:
                        merged.clear()
                    merged[pre_token] = n
            total += n
        return total


def count_tokens(
    docs: DataFrame, model_path: str, text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    The model file is read where the plan is made and travels with it (a vocabulary, half a megabyte).
    """
    with open(model_path, "rb") as file:
        model = file.read()
    shared, key = docs.sparkSession.sparkContext.broadcast(model), hashlib.sha1(model).hexdigest()

    def make():
        counter = remembered(key, lambda: TokenCounter(shared.value))

        def one(texts):
            return [
                [len(t) if t else 0 for t in texts],
                [counter.count(t.decode("utf-8", "replace")) if t else 0 for t in texts],
            ]

        return one

    counted = add_columns(docs, [text], "n_bytes bigint, n_tokens bigint", make)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
