"""Requests to and replies of chat and embedding services, over an injected transport."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexframe.functions.text import clean_base_url

#: ``transport(method, url, headers, body or None) -> reply text``; the caller brings its own HTTP.
Transport = Callable[[str, str, dict[str, str], str | None], str]

# fixed values: kinds of providers, and their addresses for models and chat
KINDS = ("OLLAMA", "OPENAI", "OPENAI_COMPATIBLE")
PATHS = {"OLLAMA": ("/api/tags", "/api/chat"), "OPENAI": ("/models", "/chat/completions"), "OPENAI_COMPATIBLE": ("/models", "/chat/completions")}


def _headers(key: str | None) -> dict[str, str]:
    return {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})


def models_request(kind: str, base_url: str, key: str | None = None) -> tuple[str, str, dict[str, str], None]:
    return "GET", base_url.rstrip("/") + PATHS[kind][0], _headers(key), None


def chat_request(kind: str, base_url: str, model: str, messages: list[dict], key: str | None = None) -> tuple[str, str, dict[str, str], str]:
    body = {"model": model, "messages": messages} | ({"stream": False} if kind == "OLLAMA" else {})
    return "POST", base_url.rstrip("/") + PATHS[kind][1], _headers(key), json.dumps(body, ensure_ascii=False)


def chat_function(transport: Transport, kind: str, base_url: str, model: str, system: str, key: str | None = None) -> Callable[[str], str]:
    """``prompt -> reply`` for :func:`codexframe.plans.jobs.analyze`; an empty reply is an error."""

    def chat(prompt: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        reply = json.loads(transport(*chat_request(kind, base_url, model, messages, key)))
        said = reply["message"]["content"] if kind == "OLLAMA" else reply["choices"][0]["message"]["content"]
        if not (said or "").strip():
            raise ValueError("the model gave no text")
        return said

    return chat


def model_names(reply: Column, kind: str) -> Column:
    """Distinct model names of a listing, sorted."""
    if kind == "OLLAMA":
        names = F.from_json(reply, "models array<struct<name:string>>")["models"]["name"]
    else:
        names = F.from_json(reply, "data array<struct<id:string>>")["data"]["id"]
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != "")))


def chat_content(reply: Column, kind: str) -> Column:
    """Text of a chat reply."""
    if kind == "OLLAMA":
        return F.from_json(reply, "message struct<content:string>")["message"]["content"]
    return F.get(F.from_json(reply, "choices array<struct<message:struct<content:string>>>")["choices"], F.lit(0))["message"]["content"]


def public_columns(providers) -> list[Column]:
    """A provider's columns without its secret, and whether it has one."""
    return [
        *[(clean_base_url(F.col(c)) if c == "base_url" else F.col(c)).alias(c) for c in providers.columns if c != "encrypted_api_key"],
        F.col("encrypted_api_key").isNotNull().alias("has_api_key"),
    ]
