"""Chat formatting at the level of token ids.

Roles and contents are encoded by themselves and spliced between reserved ids, so no pair merges over a
border and no content can yield a reserved id. A conversation becomes

    START role-ids NEWLINE content-ids END NEWLINE   for each turn, and EOT at its end,

where EOT, START and END are the three ids behind the vocabulary's last one,
and the loss mask is 1 on the content and END of the trained role's turns. The mask is derived by
prefix sums: segment lengths give offsets, each trained segment adds 1 at its start and -1 behind its
end, and the running sum is the mask.

A control string in a content ("<|start|>" and the like) is escaped by a backslash behind its "<";
one that is already escaped gets one more, so unescape(escape(x)) = x for every x.

Defined results: turns go by turn number, ties by role and then text; repeated rows are turns of their own;
a NULL turn number comes first; a NULL role is the role "user"; a NULL text is an empty one; each row
with a NULL conv_id is a conversation by itself; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm.bpe import VOCABULARY, encoder, ranks
from ostinata.llm.common import table

#: Control strings, in the order of their reserved ids.
CONTROL = ("<|endoftext|>", "<|start|>", "<|end|>")
TRAINED = "assistant"
#: Roles that a worker remembers.
ROLES = 10_000
_NAMES = "|".join(re.escape(c[2:-2]) for c in CONTROL)
_PLAIN = re.compile(rf"<(\\*)\|({_NAMES})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({_NAMES})\|>")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: f"<\\{m[1]}|{m[2]}|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|{m[2]}|>", text)


def reserved(vocabulary: dict[bytes, int]) -> tuple[int, int, int]:
    """EOT, START and END of a vocabulary: ids that it doesn't hold."""
    last = max(vocabulary.values())
    return last + 1, last + 2, last + 3


def assemble(roles: list[list[int]], contents: list[list[int]], trained: list[bool], newline: list[int], own: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of a conversation from its encoded segments."""
    eot, start, end = own
    parts, sizes, learn = [], [], []
    for role, content, t in zip(roles, contents, trained):
        for segment, on in (([start, *role, *newline], False), ([*content, end], t), (newline, False)):
            parts.append(np.asarray(segment, np.int32))
            sizes.append(len(segment))
            learn.append(on)
    parts.append(np.array([eot], np.int32))
    sizes.append(1)
    learn.append(False)
    ends = np.cumsum(sizes)
    step = np.zeros(ends[-1] + 1, np.int32)
    on = np.array(learn)
    np.add.at(step, (ends - sizes)[on], 1)
    np.add.at(step, ends[on], -1)
    return np.concatenate(parts), np.cumsum(step[:-1])


def format_chats(turns: DataFrame, path: str = VOCABULARY, trained: str = TRAINED) -> DataFrame:
    """conv_id, n_turns, ids, mask, n_trained of every conversation."""
    vocabulary = ranks(path)

    @F.pandas_udf("ids array<int>, mask array<int>")
    def spliced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode, own = encoder(vocabulary).encode_ordinary, reserved(vocabulary)
        known: dict[str, list[int]] = {}
        newline = encode("\n")
        for roles, texts in batches:
            if len(known) > ROLES:
                known.clear()
            out = []
            for r, t in zip(roles, texts):
                r = list(r)
                coded = [known[x] if x in known else known.setdefault(x, encode(escape(x))) for x in r]
                out.append(assemble(coded, [encode(escape(x)) for x in t], [x == trained for x in r], newline, own))
            yield pd.DataFrame({"ids": [a for a, _ in out], "mask": [b for _, b in out]})

    # rows without a conversation don't meet
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("_lone")
    t = turns.select("conv_id", lone, F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = t.groupBy("conv_id", "_lone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    done = whole.select("conv_id", F.size("t").alias("n_turns"), spliced(F.col("t.role"), F.col("t.text")).alias("s"))
    return done.select("conv_id", "n_turns", "s.ids", "s.mask", F.aggregate("s.mask", F.lit(0), lambda a, x: a + x).alias("n_trained"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
