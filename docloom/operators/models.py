"""Model calls behind one interface: a client answers prompts; an answer that does not hold is sent back with the reason.

Labels of a document are asked for in order, because each prompt names what came before: documents are independent,
so they are dealt out to workers and each is worked through in one of them. Retries are always bounded.
"""

from __future__ import annotations

import json
import os
import pathlib
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OTHER, SECTION_IDS, SECTIONS

Message = dict[str, str]
WINDOW = 8


class ModelClient(Protocol):
    """Anything that answers a list of messages with a text; it is pickled and sent to workers."""

    def complete(self, messages: list[Message]) -> str: ...


@dataclass
class RuleModel:
    """An offline model of section labels: cues in the last message, in catalog order."""

    cues: tuple[tuple[str, tuple[str, ...]], ...]

    def complete(self, messages: list[Message]) -> str:
        text = next(m["content"] for m in messages if m["role"] == "user").partition("\nText:\n")[2].lower()
        found = sorted({s for s, words in self.cues if any(w in text for w in words)})
        return json.dumps({"sections": found or [OTHER]})


@dataclass
class ReplayModel:
    """Recorded answers in order, for tests and audits."""

    answers: list[str]
    asked: list[list[Message]] = field(default_factory=list)

    def complete(self, messages: list[Message]) -> str:
        self.asked.append(list(messages))
        return self.answers[min(len(self.asked), len(self.answers)) - 1]


def base_urls(url: str) -> list[str]:
    """Where a chat endpoint may be: the address given, then the same with or without /v1."""
    url = url.strip().rstrip("/")
    if not url:
        raise ValueError("the base URL is empty")
    return [url, url.removesuffix("/v1").rstrip("/") if url.endswith("/v1") else f"{url}/v1"]


@dataclass
class HttpModel:
    """A chat-completions endpoint over HTTP; it is pickled with its settings and opens a connection per call."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 120.0

    def _post(self, messages: list[Message], **more) -> dict:
        body = json.dumps({"model": self.model, "temperature": 0, "messages": messages, **more}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/chat/completions", body, head), timeout=self.timeout) as answer:
            return json.load(answer)

    def complete(self, messages: list[Message]) -> str:
        return self._post(messages)["choices"][0]["message"]["content"] or ""


def connect(base_url: str, model: str, api_key: str = "", timeout: float = 120.0) -> HttpModel:
    """A client for the first address that answers a short question; only a 404 moves on to the next one."""
    tried = base_urls(base_url)
    for url in tried:
        client = HttpModel(url, model, api_key, timeout)
        try:
            client._post([{"role": "user", "content": "ping"}], max_tokens=1)
            return client
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise RuntimeError(f"{url} refused a first question: {e}") from e
        except OSError as e:
            raise RuntimeError(f"{url} cannot be reached: {e}") from e
    raise RuntimeError(f"nothing answers at {' or '.join(tried)}")


@dataclass(frozen=True)
class Settings:
    """How models are called; from_env() reads DOCLOOM_* variables."""

    base_url: str = ""
    model: str = ""
    api_key: str = ""
    attempts: int = 6
    interactive: bool = False

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        get = lambda k, d: env.get(f"DOCLOOM_{k}", d)
        return cls(get("BASE_URL", ""), get("MODEL", ""), get("API_KEY", ""), int(get("ATTEMPTS", "6")), get("INTERACTIVE", "") == "1")


def section_prompts(folder: str) -> dict[str, str]:
    """System prompts by section, from files SECnn.txt or SECnn.md of a folder; one row per section, small enough to broadcast."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(pathlib.Path(folder).iterdir()) if p.suffix in (".txt", ".md") and p.stem in SECTION_IDS}


def check_labels(answer: str) -> list[str]:
    """Labels of an answer, repeats gone, in the model's order; ValueError says what is wrong."""
    value = json.loads(answer)
    if not isinstance(value, dict) or set(value) != {"sections"}:
        raise ValueError("the answer must be an object with only `sections`")
    labels = value["sections"]
    if not isinstance(labels, list) or not all(isinstance(x, str) for x in labels):
        raise ValueError("`sections` must be a list of strings")
    labels = list(dict.fromkeys(x.strip() for x in labels))
    if unknown := [x for x in labels if x not in SECTION_IDS]:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    if not labels:
        raise ValueError("`sections` is empty")
    return labels


def prompt(text: str, earlier: list[tuple[str, list[str]]]) -> list[Message]:
    """Messages that ask for one chunk's labels."""
    seen = list(dict.fromkeys(x for _, labels in earlier for x in labels))
    catalog = "\n".join(f"{s}: {english} ({arabic})" for s, arabic, english in SECTIONS)
    recent = "\n".join(f"{name}: {', '.join(labels)}" for name, labels in earlier[-WINDOW:]) or "none"
    return [
        {"role": "system", "content": f"Label a chunk of a procedure document with all sections it belongs to. Answer with JSON, {{\"sections\": [ids]}}.\n{catalog}"},
        {"role": "user", "content": f"Sections so far: {', '.join(seen) or 'none'}\nLast chunks:\n{recent}\nText:\n{text}"},
    ]


def ask(client: ModelClient, messages: list[Message], check: Callable[[str], object], attempts: int = 6) -> tuple[object | None, list[tuple[str, str]]]:
    """The checked answer, or None after the last attempt, and the failed ones (answer, reason)."""
    talk, failed = list(messages), []
    for _ in range(max(1, attempts)):
        answer = client.complete(talk)
        try:
            return check(answer), failed
        except ValueError as e:
            failed.append((answer, str(e)))
            talk += [{"role": "assistant", "content": answer}, {"role": "user", "content": f"That answer does not hold: {e}. Answer again with JSON only."}]
    return None, failed


def label_documents(chunks: DataFrame, client: ModelClient, attempts: int = 6, doc: str = "doc_id", order: str = "chunk_index", name: str = "file_name", text: str = "content", skipped: str = "skipped") -> DataFrame:
    """(doc, order, labels, retries, error): each document's chunks in order; skipped ones get no labels and no call.

    One document is one group, in one worker: the calls of a document depend on each other.
    """

    def run(key, rows):
        rows = rows.sort_values(order)
        earlier: list[tuple[str, list[str]]] = []
        out = []
        for n, file, body, skip in zip(rows[order], rows[name], rows[text], rows[skipped]):
            labels, failed = ([], []) if skip else ask(client, prompt(body or "", earlier), check_labels, attempts)
            if not skip:
                earlier.append((file, labels or []))
            out.append((key[0], n, labels or [], len(failed), failed[-1][1] if labels is None else None))
        return pd.DataFrame(out, columns=[doc, order, "labels", "retries", "error"])

    types = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    return chunks.groupBy(doc).applyInPandas(run, f"{doc} {types[doc]}, {order} {types[order]}, labels array<string>, retries int, error string")


def answer(prompts: DataFrame, client: ModelClient, check: Callable[[str], object], attempts: int = 6, key: str = "id", system: str = "system", user: str = "user") -> DataFrame:
    """(key, answer, attempts, error): each prompt asked by itself; the answer is null after the last failed attempt.

    check raises ValueError for an answer that does not hold. What to use instead of a null answer is the caller's
    to say, by a coalesce with its own fallback.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, s, u in zip(f[key], f[system], f[user]):
                got, failed = ask(client, [{"role": "system", "content": s}, {"role": "user", "content": u}], check, attempts)
                out.append((k, None if got is None else json.dumps(got, ensure_ascii=False), len(failed) + (got is not None), failed[-1][1] if got is None and failed else None))
            yield pd.DataFrame(out, columns=[key, "answer", "attempts", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, system, user).mapInPandas(run, f"{key} {kind}, answer string, attempts int, error string")


RESOLVED, FALLBACK, FAILED = "resolved", "fallback", "failed"


def outcomes(answered: DataFrame, fallback: DataFrame, key: str = "id", value: str = "value") -> DataFrame:
    """(key, value, status, attempts, error) of every answered prompt: the model's answer, else what the rules gave for it, else nothing.

    fallback has key and value; a null value is none. Keys of the fallback that were not asked for are left out.
    """
    other = fallback.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    j = answered.join(other, F.col(key).eqNullSafe(F.col("__key")), "left")
    status = F.when(F.col("answer").isNotNull(), RESOLVED).when(F.col("__value").isNotNull(), FALLBACK).otherwise(FAILED)
    return j.select(key, F.coalesce("answer", "__value").alias(value), status.alias("status"), "attempts", "error")


def outcome_summary(found: DataFrame, *by: str) -> DataFrame:
    """Per document or other group: prompts, how many came out each way, and the attempts beyond the first."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(f"n_{s}")
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n_asked"), n(RESOLVED), n(FALLBACK), n(FAILED), F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).alias("retries"))
