"""Models behind small interfaces, with deterministic local defaults.

A provider is a picklable object; a Python worker has one of each (quern.operators.asking).  A
remote provider raises Filtered where its content filter refuses, and Busy or OSError where a later try may
succeed; `retrying` waits with exponential jitter, 1 to 60 seconds, ten times at most."""

from __future__ import annotations

import base64
import hashlib
import json
import logging
import random
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from http.client import HTTPConnection, HTTPException, HTTPSConnection
from typing import Protocol
from urllib.parse import urlsplit

import numpy as np

from quern.functions.text import FAILED


class Filtered(Exception):
    """The provider's content filter refused: the answer is null, no retry."""


class Busy(Exception):
    """Rate limit or a passing failure."""


class Oversize(Exception):
    """The image is too large for the provider: a smaller one may do."""


#: What each stage asks for, by what its nodes are for: a question must meet them in a search, so they are
#: to hold the words that it would be asked in.  {context} is the summary of the page that a node comes from.
INSTRUCTIONS = {
    "entities": "List the named people, organisations, places and dates of the text, once each, separated by commas.",
    "entity_rows": "Call the function with every person, organisation, place and date that the text names; as context a few words of the text around each.",
    "summary": "Sum up the text in six sentences. It comes from a page about this: {context}",
    "key_takeaways": "Name the points of the text that a reader should remember, one a line, each after a dash. It comes from a page about this: {context}",
    "table_analysis": "Answer the questions that somebody would look this CSV table up for, in five sentences at most, with its figures and the names of its columns. Page: {context}",
    "image_description": "Write a caption of three sentences at most by which a reader could find this picture without seeing it. Answer error: unable if you cannot. Page: {context}",
    "image_entities": "Give up to twenty search terms, separated by commas, under which this picture should be filed. Answer error: unable if you cannot. Page: {context}",
    "plot_insights": "Put what this figure proves into statements that hold without it, one a line, six at most, each with its numbers and units. Answer error: unable if you cannot. Page: {context}",
    "classify": "Is the picture a plot, chart or diagram, or another image? Answer with one word: plot or image.",
    "queries": "Write four other search queries that would find what answers the question, one a line, without numbers.",
    "answer": "Answer the question.",
    "check": "The text is a draft, then facts after a line of dashes. Write the sentences of the draft that the facts do not bear out, one a line; nothing if there are none.",
}
#: Between a draft and the facts that it is held against.
DASHES = "\n----\n"
#: The kinds of entities, as an answer's fields name them.
ENTITY_KINDS = {"persons": "person", "organizations": "organization", "locations": "location", "dates": "date"}
#: The form that entity_rows asks for.
_ENTITY = {"type": "object", "properties": {"name": {"type": "string"}, "context": {"type": "string"}}, "required": ["name", "context"]}
FUNCTIONS = {
    "entity_rows": {"name": "entities", "description": "The entities of a text by kind", "parameters": {"type": "object", "properties": {k: {"type": "array", "items": _ENTITY} for k in ENTITY_KINDS}, "required": list(ENTITY_KINDS)}},
}


@dataclass(frozen=True)
class Request:
    """What a stage asks a model: its name, the text or image, and where these come from."""

    stage: str
    text: str | None = None
    title: str = ""
    context: str = ""
    image: bytes | None = None

    def prompt(self) -> str:
        return INSTRUCTIONS[self.stage].format(context=self.context or "not known")

    def with_image(self, image: bytes) -> Request:
        return replace(self, image=image)


@dataclass(frozen=True)
class Answer:
    """What a model said, and the tokens that it took."""

    text: str | None
    tokens: int = 0


def answered(provider, request: Request) -> Answer:
    """A provider's answer; one that counts no tokens has complete, describe and classify only."""
    if hasattr(provider, "answer"):
        return provider.answer(request)
    if request.stage == "classify":
        return Answer(provider.classify(request.image, request.title))
    vision = request.stage in ("image_description", "image_entities", "plot_insights")
    return Answer((provider.describe if vision else provider.complete)(request))


class Embedding(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class ImageEmbedding(Protocol):
    dim: int

    def embed_images(self, images: list[bytes]) -> list: ...


class Text(Protocol):
    def complete(self, request: Request) -> str | None: ...


class Vision(Protocol):
    def describe(self, request: Request) -> str | None: ...

    def classify(self, image: bytes | None, name: str) -> str: ...


class JsonClient:
    """POST of JSON over connections that are kept, one for each thread and host."""

    def __init__(self, timeout: float = 120):
        self.timeout, self.own = timeout, threading.local()

    def __reduce__(self):
        return JsonClient, (self.timeout,)

    def __call__(self, url: str, body: dict, headers: dict[str, str]) -> tuple[int, dict]:
        """(status, response); a connection that the other side has closed meanwhile is opened again once."""
        where = urlsplit(url)
        held = self.own.__dict__.setdefault("held", {})
        key = (where.scheme, where.netloc)
        for fresh in (key not in held, True):
            if fresh:
                held[key] = (HTTPSConnection if where.scheme == "https" else HTTPConnection)(where.netloc, timeout=self.timeout)
            try:
                held[key].request("POST", where.path + ("?" + where.query if where.query else ""), json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
                answer = held[key].getresponse()
                raw = answer.read()
                break
            except (HTTPException, OSError) as error:
                held.pop(key).close()
                if fresh:
                    raise OSError(str(error)) from error
        try:
            return answer.status, json.loads(raw or b"{}")
        except ValueError:
            return answer.status, {}


post_json = JsonClient()


@dataclass(frozen=True)
class ChatModel:
    """A remote chat model that takes text and images, as a text and a vision provider.

    send(url, body, headers) gives (status, response); errors become Filtered, Busy or Oversize.  Each
    response's tokens and their price are logged."""

    url: str
    key: str = ""
    send: Callable[[str, dict, dict], tuple[int, dict]] = post_json
    max_tokens: int = 800
    temperature: float = 0.7
    top_p: float = 0.95
    token_price: float = 0.00002

    def body(self, request: Request) -> dict:
        parts = [{"type": "text", "text": request.prompt()}]
        if request.text:
            parts.append({"type": "text", "text": request.text})
        if request.image is not None:
            parts.append({"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(request.image).decode()}})
        out = {"messages": [{"role": "system", "content": "You prepare pages for a knowledge graph."}, {"role": "user", "content": parts}], "max_tokens": self.max_tokens, "temperature": self.temperature, "top_p": self.top_p}
        form = FUNCTIONS.get(request.stage)
        return out | {"functions": [form], "function_call": {"name": form["name"]}} if form else out

    def answer(self, request: Request) -> Answer:
        status, response = self.send(self.url, self.body(request), {"api-key": self.key})
        code = str((response.get("error") or {}).get("code", ""))
        if status == 400 and code == "content_filter":
            raise Filtered
        if status == 413 or status == 400 and "large" in code:
            raise Oversize
        if status != 200:
            raise Busy(f"status {status}")
        tokens = (response.get("usage") or {}).get("total_tokens", 0)
        logging.getLogger("quern").info("%d tokens, %.4f", tokens, tokens * self.token_price)
        try:
            said = response["choices"][0]["message"]
            return Answer(said["function_call"]["arguments"] if said.get("function_call") else said["content"], tokens)
        except (KeyError, IndexError, TypeError):
            return Answer(FAILED, tokens)

    def complete(self, request: Request) -> str | None:
        return self.answer(request).text

    describe = complete

    def classify(self, image: bytes | None, name: str) -> str:
        return self.complete(Request("classify", title=name, image=image)) or ""


@dataclass(frozen=True)
class RemoteEmbedding:
    """Vectors of texts from a remote model."""

    url: str
    dim: int
    key: str = ""
    send: Callable[[str, dict, dict], tuple[int, dict]] = post_json
    batch: int = 64  # texts to a call

    def embed(self, texts: list[str]) -> np.ndarray:
        status, response = self.send(self.url, {"input": texts}, {"api-key": self.key})
        if status != 200:
            raise Busy(f"status {status}")
        return np.array([d["embedding"] for d in sorted(response["data"], key=lambda d: d["index"])], np.float32).reshape(len(texts), self.dim)


@dataclass(frozen=True)
class RemoteImageEmbedding:
    """Vectors of images from a remote model, one call for each image."""

    url: str
    dim: int
    key: str = ""
    send: Callable[[str, dict, dict], tuple[int, dict]] = post_json
    batch: int = 1

    def embed_images(self, images: list[bytes]) -> list:
        out = []
        for data in images:
            status, response = self.send(self.url, {"image": base64.b64encode(data).decode()}, {"api-key": self.key})
            if status == 400:  # no image that the model can read
                out.append(None)
                continue
            if status != 200:
                raise Busy(f"status {status}")
            out.append(np.array(response["vector"], np.float32).reshape(self.dim))
        return out


def retrying(call, attempts: int = 10, low: float = 1.0, high: float = 60.0, sleep=time.sleep):
    """call's result, or None if it is refused; other errors are tried again."""
    for n in range(attempts):
        try:
            return call()
        except Filtered:
            return None
        except (Busy, OSError):
            if n == attempts - 1:
                raise
            sleep(random.uniform(low, min(high, low * 2 ** (n + 1))))


class HashedEmbedding:
    """Words hashed to signed places of a vector, then unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n == 0, 1, n)


#: Words that tell the rule what a name stands for: before a place, and at the end of an organisation's.
_PLACE, _BODY = ("in", "from", "near"), ("Inc", "Ltd", "Company", "University", "Institute", "Bank", "Party", "Press", "Foundation", "Office")
_PHRASE = re.compile(r"(?:\b(?:%s) )?\b[A-Z][a-z]+(?: [A-Z][a-z]+)*" % "|".join(_PLACE), re.ASCII)
_NAME = re.compile(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b")
_DATE = re.compile(r"\b(?:1[0-9]{3}|20[0-9]{2})\b", re.ASCII)


def _ruled_entities(text: str) -> dict[str, list[dict[str, str]]]:
    """Entities by kind, each name once with the first words that it stands in."""
    found: dict[str, dict[str, str]] = {k: {} for k in ENTITY_KINDS}
    for phrase in _PHRASE.findall(text):
        cue, _, rest = phrase.partition(" ")
        placed = cue in _PLACE
        name = rest if placed else phrase
        kind = "locations" if placed else "organizations" if name.rsplit(" ", 1)[-1] in _BODY else "persons"
        found[kind].setdefault(name, phrase)
    for year in _DATE.findall(text):
        found["dates"].setdefault(year, year)
    return {k: [{"name": n, "context": c} for n, c in own.items()] for k, own in found.items()}


class RuleText:
    """Answers by rule, as a stand-in for a model: entities by capitals and years, summaries by first sentences."""

    def __init__(self, summary_sentences: int = 6, takeaways: int = 3):
        self.summary_sentences, self.takeaways = summary_sentences, takeaways

    def complete(self, request: Request) -> str | None:
        prompt, text = request.stage, request.text
        found = [s.strip() for s in re.findall(r"[^.!?]+[.!?]*\s*", text or "") if s.strip()]
        if prompt == "entities":
            names = list(dict.fromkeys([*_NAME.findall(text or ""), *_DATE.findall(text or "")]))
            return ", ".join(names) or None
        if prompt == "entity_rows":
            return json.dumps(_ruled_entities(text or ""), ensure_ascii=False)
        if prompt == "check":
            draft, _, facts = (text or "").partition(DASHES)
            known = set(re.findall(r"\w+", facts.lower()))
            return "\n".join(s.strip() for s in re.findall(r"[^.!?]+[.!?]*\s*", draft) if s.strip() and not set(re.findall(r"\w+", s.lower())) <= known)
        if prompt == "key_takeaways":
            longest = sorted(sorted(range(len(found)), key=lambda i: (-len(found[i]), i))[: self.takeaways])
            return "\n".join(f"- {found[i]}" for i in longest) or None
        if prompt == "queries":
            words = re.findall(r"\w+", text or "")
            return "\n".join(" ".join(words[i::4]) for i in range(min(4, len(words)))) or None
        if prompt == "table_analysis":
            rows = (text or "").strip().splitlines()
            return f"A table of {max(0, len(rows) - 1)} rows" if rows else None
        return " ".join(found[: self.summary_sentences]) or None


class NameVision:
    """Answers from an image's name alone."""

    def describe(self, request: Request) -> str | None:
        words = re.sub(r"[-_]+", " ", request.title or "").strip()
        return f"{request.stage.replace('_', ' ')}: {words}" if words else None

    def classify(self, image: bytes | None, name: str) -> str:
        low = (name or "").lower()
        return "plot" if any(w in low for w in ("plot", "chart", "graph", "diagram")) else "image"


class HashedPixels:
    """Image bytes hashed to a unit vector: equal images meet."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def embed_images(self, images: list[bytes]) -> list[np.ndarray]:
        out = []
        for data in images:
            raw = hashlib.shake_128(data).digest(self.dim)
            v = np.frombuffer(raw, np.uint8).astype(np.float32) - 127.5
            out.append(v / np.sqrt((v * v).sum()))
        return out


class Providers:
    """Models of all stages.  Without `images` image nodes get no vectors.  pace: how the stages call them
    (asking.Pace); counters: who counts what they say (counting.Counters)."""

    def __init__(self, embedding: Embedding | None = None, text: Text | None = None, vision: Vision | None = None, images: ImageEmbedding | None = None, pace=None, counters=None):
        self.pace, self.counters = pace, counters
        self.embedding = embedding or HashedEmbedding()
        self.images = images
        self.text = text or RuleText()
        self.vision = vision or NameVision()
