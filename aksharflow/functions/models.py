"""Optional models: availability checks, and a masked-token corrector in batches. Neither library nor weights are bundled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class ModelNotInstalled(ImportError):
    """An optional library is not there."""


def require(library: str, what: str) -> None:
    if find_spec(library) is None:
        raise ModelNotInstalled(f"{what} needs {library}")


def transformers_loader(name: str) -> Callable[[], Callable[[list[str]], list[str]]]:
    def load() -> Callable[[list[str]], list[str]]:
        require("transformers", "the masked-token corrector")
        from transformers import pipeline

        run = pipeline("text2text-generation", model=name)
        return lambda prompts: [r["generated_text"] for r in run(prompts, num_beams=4, max_new_tokens=8)]

    return load


def fill_mask(load: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[Column, Column, Column], Column]:
    """(token, left, right) -> token as the model fills it in; an empty answer keeps the token. The model is loaded once a worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for token, left, right in batches:
            prompts = [f"{a} <mask> {b}".strip() for a, b in zip(left.fillna(""), right.fillna(""))]
            answers = pd.Series([(x or "").strip() for x in model(prompts)], index=token.index)
            yield answers.where(answers != "", token)

    return run


def verified(content: Column, sha256: str) -> Column:
    """Whether downloaded bytes are those expected."""
    return F.sha2(content, 256) == sha256.lower()
