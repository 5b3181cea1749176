"""Models for the edges of building and asking, made from settings.

Chat models are reached over HTTP at ``{base_url}/chat/completions``; the embedder is a sentence-transformers model where
that library is installed.  Calls that fail raise; whoever calls decides what an error costs.
"""

from __future__ import annotations

import json
import urllib.request
from typing import Any

from quarry.plans.evidence import Models
from quarry.sources.config import Settings

PARAPHRASE = "Rewrite the question in {n} other ways that keep its meaning, in its own language. One a line, no numbers, nothing else.\n\n{question}"
VERIFY = "Does the text help to answer the question? Reply with YA or TIDAK only.\n\nQuestion: {question}\n\nText:\n{text}"
ANSWER = "Answer the question from these passages alone and in its own language. After each statement name its file as (Sumber: file). If the passages don't hold the answer, say so.\n\nQuestion: {question}\n\n{passages}"
REFORMAT = "Bring this page into clean Markdown. Keep every number, percentage, code and name exactly as it is; add and leave out nothing.\n\n{text}"
EMBEDDER = "paraphrase-multilingual-MiniLM-L12-v2"
_LOADED: dict[str, Any] = {}


def completed(model: dict[str, Any], prompt: str, temperature: float, seconds: float = 120.0) -> str:
    """A chat model's reply to one message."""
    body = {"model": model.get("model"), "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {model['api_key']}"} if model.get("api_key") else {})
    asked = urllib.request.Request(f"{model['base_url'].rstrip('/')}/chat/completions", json.dumps(body).encode(), headers)
    with urllib.request.urlopen(asked, timeout=seconds) as got:
        return json.load(got)["choices"][0]["message"]["content"] or ""


def embedder(name: str):
    """Unit vectors of texts; the model is loaded once a process."""

    def embed(texts: list[str]) -> list[list[float]]:
        if name not in _LOADED:
            from sentence_transformers import SentenceTransformer

            _LOADED[name] = SentenceTransformer(name)
        return _LOADED[name].encode(texts, batch_size=32, normalize_embeddings=True).tolist()

    return embed


def installed(library: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(library) is not None


def from_settings(settings: Settings) -> Models:
    """What the settings name and this machine has; the rest is left to the offline stand-ins."""
    model = settings.model
    embed = embedder(settings.embedding_model or EMBEDDER) if installed("sentence_transformers") else None
    if not model.get("base_url") or not model.get("model"):
        return Models(embed=embed, synonyms=settings.synonyms)

    def answer(question: str, evidence: list[dict]) -> str:
        passages = "\n\n".join(f"[{e.get('knowledge_base') or 'unknown'}] {e['file']}:\n{e['text']}" for e in evidence)
        return completed(model, ANSWER.format(question=question, passages=passages), 0)

    return Models(
        paraphrase=lambda question, n: completed(model, PARAPHRASE.format(question=question, n=n), 0.3),
        verify=lambda question, text: completed(model, VERIFY.format(question=question, text=text), 0),
        answer=answer,
        reformat=lambda text: completed(model, REFORMAT.format(text=text), 0),
        embed=embed,
        synonyms=settings.synonyms,
    )
