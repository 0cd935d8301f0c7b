"""Models behind HTTP as plug-ins: embeddings, answers and entity scans over any endpoint of the usual JSON shapes.

Each function returns a ``load`` for the operators that take one: workers call it once and then the model it gives. The
address is always the caller's; keys come from an environment variable that the caller names.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable


class MissingKey(RuntimeError):
    """The environment variable that should hold a key is not set."""


def _post(url: str, body: dict, key_variable: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"}
    if key_variable:
        if not (key := os.environ.get(key_variable)):
            raise MissingKey(f"{key_variable} is not set")
        headers["Authorization"] = f"Bearer {key}"
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
        return json.loads(reply.read())


def http_embeddings(url: str, model: str, dim: int, key_variable: str | None = None, batch: int = 64, timeout: float = 60.0) -> Callable[[], Callable[[list[str]], list]]:
    """``{model, input}`` to ``{data: [{index, embedding}]}``, 64 texts a request; vectors go by index, and are cut or filled with zeros to ``dim``."""

    def load():
        def embed(texts: list[str]) -> list:
            out: list = []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                found = {int(d.get("index", i)): d["embedding"] for i, d in enumerate(_post(url, {"model": model, "input": some}, key_variable, timeout)["data"])}
                out += [(list(found.get(i, ())) + [0.0] * dim)[:dim] for i in range(len(some))]
            return out

        return embed

    return load


def http_chat(url: str, model: str, key_variable: str | None = None, timeout: float = 120.0) -> Callable[[], Callable[[str, str], str]]:
    """``{model, messages}`` to the reply's text, which is looked for in ``choices``, ``message`` or ``response``."""

    def load():
        def write(system: str, prompt: str) -> str:
            messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
            return chat_text(_post(url, {"model": model, "messages": messages, "stream": False}, key_variable, timeout))

        return write

    return load


def chat_text(reply: dict) -> str:
    """The text of a chat endpoint's reply; ValueError if there is none."""
    first = (reply.get("choices") or [{}])[0]
    for place in (first.get("message"), reply.get("message")):
        if isinstance(place, dict) and isinstance(place.get("content"), str):
            return place["content"]
    if isinstance(reply.get("response"), str):
        return reply["response"]
    raise ValueError("the reply holds no text")


#: Embedding models by the first part of a name such as ``http:model``, as functions of what follows the colon.
MODELS: dict[str, Callable[[str], Callable]] = {}


def embedding_model(name: str) -> Callable[[], Callable[[list[str]], list]]:
    """The ``load`` that a name ``kind:rest`` stands for, of the kinds registered in MODELS; ValueError for others."""
    kind, _, rest = name.partition(":")
    if kind not in MODELS:
        raise ValueError(f"no kind of model {kind!r}; there are {sorted(MODELS)}")
    return MODELS[kind](rest)
