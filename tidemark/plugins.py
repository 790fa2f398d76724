"""Services that a caller plugs in: each is a Python function of a batch, applied to partitions through Arrow.

Functions are pickled to the workers; they may hold a client's address, not an open connection. A result of another length than
the batch is an error. Nothing here knows a transport: where no function is given, stored tables stand for the service.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _checked(found, want: int, what: str):
    if len(found) != want:
        raise ValueError(f"{what}: {len(found)} results for {want} inputs")
    return found


def embed(rows: DataFrame, key: str, text: str, client: Callable[[list[str]], list[list[float]]], model: str, batch: int = 64) -> DataFrame:
    """Vectors of texts: (key, model, dims, vec), one row per row, in calls of at most that many texts."""
    kind = dict(rows.dtypes)[key]

    def run(frames):
        for pdf in frames:
            vec = [v for at in range(0, len(pdf), batch) for v in _checked(client(pdf[text].iloc[at : at + batch].tolist()), len(pdf.iloc[at : at + batch]), "embed")]
            yield pd.DataFrame({key: pdf[key], "model": model, "dims": [len(v) for v in vec], "vec": vec})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, model string, dims int, vec array<float>")


def reranker(score: Callable[[str, list[str]], list[float]]) -> Callable[[DataFrame], DataFrame]:
    """A reranker for a search, of a scorer of one query and its documents; a query on which it fails is left out, and keeps its order."""

    def rerank(given: DataFrame) -> DataFrame:
        kind, name = dict(given.dtypes)["query_id"], dict(given.dtypes)["name"]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("name")
            try:
                found = _checked(score(pdf["text"].iloc[0], pdf["content"].tolist()), len(pdf), "rerank")
            except Exception:  # a service that fails must not lose results
                return pd.DataFrame({"query_id": [], "name": [], "score": []})
            return pd.DataFrame({"query_id": pdf["query_id"], "name": pdf["name"], "score": [float(x) for x in found]})

        # some tens of candidates for each query
        return given.groupBy("query_id").applyInPandas(run, f"query_id {kind}, name {name}, score double")

    return rerank


def ask(rows: DataFrame, key: str, system: str, user: str, model: Callable[[str, str], str]) -> DataFrame:
    """A model's answer to each row's prompts: (key, answer); a failed call answers null."""
    kind = dict(rows.dtypes)[key]

    def run(frames):
        for pdf in frames:
            out = []
            for s, u in zip(pdf[system], pdf[user]):
                try:
                    out.append(model(s, u))
                except Exception:  # the row's answer is missing, the others' are not
                    out.append(None)
            yield pd.DataFrame({key: pdf[key], "answer": pd.Series(out, dtype=object)})

    return rows.select(key, system, user).mapInPandas(run, f"`{key}` {kind}, answer string")


def count_tokens(rows: DataFrame, key: str, text: str, counter: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(key, tokens): by a counter, or the number of words."""
    if counter is None:
        return rows.select(key, F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long").alias("tokens"))
    kind = dict(rows.dtypes)[key]

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], "tokens": _checked(counter(pdf[text].tolist()), len(pdf), "count")})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, tokens long")


def segments(turns: DataFrame, session: str, order: str, text: str, segmenter: Callable[[list[str]], list[bool]]) -> DataFrame:
    """Episodes of sessions by a function that marks the turns at which one begins: (session, episode, first, last)."""
    kind, place = dict(turns.dtypes)[session], dict(turns.dtypes)[order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        episode = pd.Series(_checked(segmenter(pdf[text].tolist()), len(pdf), "segment"), index=pdf.index).astype(int).cumsum()
        g = pdf.groupby(episode - episode.iloc[0])[order]
        return pd.DataFrame({session: pdf[session].iloc[0], "episode": g.min().index, "first": g.min().to_numpy(), "last": g.max().to_numpy()})

    # one session at once: sessions are short by nature
    return turns.select(session, order, text).groupBy(session).applyInPandas(run, f"`{session}` {kind}, episode int, first {place}, last {place}")


def suppressor(least: float = 0.7, also: Callable[[Column, Column], Column] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A test of pairs of facts (existing, incoming, similarity): the built-in floor, or a caller's condition on the two texts."""

    def keep(pairs: DataFrame) -> DataFrame:
        hit = F.col("similarity") >= least
        return pairs.where(hit | also(F.col("existing"), F.col("incoming")) if also else hit)

    return keep


def manifest_score(hits: Column, used: Column) -> Column:
    """The order of a manifest unless another is given: uses, and between equal ones the later used."""
    seconds = F.coalesce(F.unix_micros(used) / 1e6, F.lit(0.0))
    return hits + seconds / (seconds + 1e12)


def representation(anchors: DataFrame, renderer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates that a renderer makes of anchors: its rows must name the anchor (projection_id) and have a text, blank ones go."""
    return renderer(anchors).where("projection_id IS NOT NULL AND trim(text) <> ''")
