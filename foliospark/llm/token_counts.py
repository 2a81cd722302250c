"""Token counts (10): prefix dynamic programming stores the exact token count at every prefix."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, pairwise
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import small, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: The model's mark for a blank.
_MARK = "▁"
#: Counts of chunks up to so many characters are kept for later texts, of so many chunks at a time.
CHUNK_CHARS, CHUNKS = 64, 1_000_000


class Model:
    """A sentencepiece BPE model as tables, and the dynamic programming over its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.vocab_size()
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in plain}
        self.tails = {p[k:] for p in self.score for k in range(len(p))}
        if max(map(len, self.score), default=1) > 120:
            raise ValueError("a piece of more than 120 characters: steps of a byte can't hold its counts")
        # where no piece has a blank after another character, no merge crosses the beginning of
        # a run of blanks and counts add up there; otherwise a text is one chunk
        apart = not any(_MARK in p.lstrip(_MARK) for p in self.score)
        self.chunk = re.compile(f"{_MARK}+[^{_MARK}]*" if apart else "(?s:.+)")
        self.after: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, bytes] = {}

    def counts(self, chunk: str, last: list[str] | None = None, count: list[int] | None = None) -> list[int]:
        """[0, tokens of chunk[:1], tokens of chunk[:2], ...] by dynamic programming over the last
        token. `last` and `count` have what is known of a prefix and are carried on.

        A prefix's encoding is a shorter prefix's encoding and one token more. Of the tokens
        that end at i exactly one stays apart from the last token of the shorter prefix when
        the two are merged together. A character without a piece counts as its UTF-8 bytes.
        """
        score, tails, after = self.score, self.tails, self.after
        last, count = ([""], [0]) if last is None else (last, count)
        for i in range(len(last), len(chunk) + 1):
            j = i - 1
            piece = chunk[j]
            known = piece in score
            while True:
                if known or j == i - 1:
                    apart = after.get((last[j], piece)) if j else True
                    if apart is None:
                        apart = self._apart(last[j], piece)
                    if apart:
                        last.append(piece)
                        count.append(count[j] + (1 if known else len(piece.encode("utf-8", "surrogatepass"))))
                        break
                j -= 1
                piece = chunk[j:i]
                if j < 0 or piece not in tails:
                    raise ValueError(f"no token of the model ends {chunk[:i]!r}")
                known = piece in score
        return count

    def _apart(self, a: str, b: str) -> bool:
        if len(self.after) >= CHUNKS:
            self.after.clear()
        got = self.after[a, b] = self._merged(a + b) == [a, b]
        return got

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best-scored neighbours merge first, the left of equals."""
        got = list(text)
        while len(got) > 1:
            best = max(((self.score[p], -k) for k in range(len(got) - 1) if (p := got[k] + got[k + 1]) in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            got[k : k + 2] = [got[k] + got[k + 1]]
        return got

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """What each character of the chunks adds to the count, a signed byte each. In sorted order
        a chunk goes on from the prefix that it shares with the one before. The library's own
        counts of the chunks are the check; where they differ it encodes each prefix."""
        if len(self.steps) + len(chunks) > CHUNKS:
            self.steps.clear()
        new = sorted(chunks - self.steps.keys())
        before, last, count = "", [""], [0]
        for chunk, ids in zip(new, self.library.encode([c[1:] for c in new], num_threads=1)):
            k = len(commonprefix((before, chunk)))
            del last[k + 1 :], count[k + 1 :]
            got, before = self.counts(chunk, last, count), chunk
            if got[-1] != len(ids) and len(chunk) > 1:
                got = [0, 1, *(len(self.library.encode(chunk[1:i])) for i in range(2, len(chunk) + 1))]
            self.steps[chunk] = bytes([b - a & 0xFF for a, b in pairwise(got)])
        return self.steps

    def prefix_steps(self, texts: list[str | None]) -> list[bytes]:
        """Of each text a signed byte a character: their sum up to any character is the exact
        number of tokens of the text up to there."""
        cut = [self.chunk.findall((_MARK + t).replace(" ", _MARK)) if t else () for t in texts]
        wanted = set(chain.from_iterable(cut))
        steps = self.learn(wanted)
        out = []
        for chunks in cut:
            got = b"".join(map(steps.__getitem__, chunks))
            # the blank before the text is no character of it, and an empty prefix has no tokens
            out.append(bytes([got[0] + got[1] & 0xFF]) + got[2:] if got else got)
        for chunk in wanted:
            if len(chunk) > CHUNK_CHARS:
                del steps[chunk]
        return out


@lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


def tokens_at(steps: bytes, offset: int) -> int:
    """Exact tokens of the first `offset` characters, from a stored row alone."""
    return int(np.frombuffer(steps, np.int8)[: max(0, offset)].sum(dtype=np.int64))


def fitting_prefix(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens, from a stored row alone."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(df: DataFrame, text: str = "text", model_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Token counts of every prefix of a text column.

    Returns the columns `keep`, n_bytes, n_tokens and prefix_steps: a signed byte for each
    character, whose sum up to any place is the exact count there. `tokens_at` and
    `fitting_prefix` answer truncation and budget questions from it without the text or the
    model. Null and empty texts have 0 bytes, 0 tokens and no steps; equal rows give equal
    rows. Texts are never cut; rows stay where they are (no shuffle), and memory is bounded by
    one slice of an Arrow batch. Columns of df that aren't in `keep` are not read.
    """
    path = model_path or public_tokenizers.path(MODEL)
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("prefix_steps", T.BinaryType())]
    )

    def run(batches):
        model = model_at(path)
        for batch in small(batches):
            texts = batch.column(batch.num_columns - 1)
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            steps = model.prefix_steps(texts.to_pylist())
            total = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size, pa.array(total, pa.int64()), pa.array(steps, pa.binary())], names=schema.names)

    # the text goes in under a name of its own, for `keep` may hold a column of any name
    return df.select(*[F.col(c) for c in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the steps of every prefix; null text counts as empty."""
    got = prefix_counts(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return got.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES: dict[str, str] = {}
