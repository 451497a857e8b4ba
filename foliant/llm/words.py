"""Words of a text as comparable units, and token counts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores or a run of other non-blank characters.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


#: Symbols (not those of ASCII, which separate anyway) and what makes no difference: marks and format characters.
_SYMBOLS, _IGNORED = regex.compile(r"[\p{S}--[\x00-\x7f]]", regex.V1), regex.compile(r"[\p{M}\p{Cf}]+")


def plain(text: str) -> str:
    """Text without case, accents, invisible characters and compatibility forms of letters and digits; a symbol such as a trade mark sign is no letter and becomes a blank."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _SYMBOLS.sub(" ", text)).casefold()
    return _IGNORED.sub("", text if text.isascii() else unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of the plain text; none for null."""
    return re.findall(r"[^\W_]+", plain(text)) if text else []


def token_count(text: Column | str) -> Column:
    """Tokens by the rule TOKEN; 0 for null."""
    x = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(x, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def with_token_count(df: DataFrame, text: str, out: str, tokenizer: str | None = None) -> DataFrame:
    """df with the number of tokens of each text, 0 for null, as bigint.

    tokenizer: the path of a public tokenizer's file on every executor: `*.json` for the library tokenizers,
    `*.model` for sentencepiece, or ranks as `*.tiktoken`; without one the rule TOKEN counts. Texts are counted whole.
    """
    if tokenizer is None:
        return df.withColumn(out, token_count(text))

    def count(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if tokenizer.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer)
            t.encode_special_tokens = True
            of = lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]
        elif tokenizer.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            of = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
        else:
            import base64

            import tiktoken

            with open(tokenizer, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            enc = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            of = lambda xs: [len(enc.encode_ordinary(x)) for x in xs]
        for s in series:
            yield pd.Series(of(["" if x is None else x for x in s]), dtype="int64")

    return df.withColumn(out, F.pandas_udf(count, "bigint")(text))
