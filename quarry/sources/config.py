"""Settings from YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

NEEDED = ("llm_config", "vectorstore_config", "chunking_config", "retrieval_config", "document_folders")


class SettingsError(ValueError):
    """Settings that are missing or can't be resolved."""


class ModelMissing(ValueError):
    """Something is asked for that needs a model which isn't there."""


class IndexMissing(FileNotFoundError):
    """There is no index yet; build one first."""


@dataclass(frozen=True)
class Settings:
    """What building and asking need; defaults are those of the settings' file format."""

    folders: list[str]
    index: str
    chunk_size: int = 800
    chunk_overlap: int = 100
    candidates: int = 15
    paraphrases: int = 3
    alpha: float = 0.5
    chunks_per_file: int = 3
    nearest: int = 4
    embedding_model: str | None = None
    reformat: bool = False
    model: dict[str, Any] = field(default_factory=dict, repr=False)
    synonyms: dict[str, list[str]] = field(default_factory=dict)


def from_environment(value: Any) -> Any:
    """``${NAME}`` as a whole stands for an environment variable that has to be set; all else stands for itself."""
    if isinstance(value, str) and value.startswith("${") and value.endswith("}"):
        if (got := os.environ.get(value[2:-1])) is None:
            raise SettingsError(f"the environment variable {value[2:-1]} isn't set")
        return got
    return value


def parsed(raw: dict[str, Any]) -> Settings:
    """Settings of a loaded file; only the model's key is looked up in the environment."""
    if absent := [k for k in NEEDED if k not in (raw or {})]:
        raise SettingsError(f"missing settings: {', '.join(absent)}")
    model = dict(raw["llm_config"] or {})
    model["api_key"] = from_environment(model.get("api_key"))
    cut, find = raw["chunking_config"] or {}, raw["retrieval_config"] or {}
    folders = raw["document_folders"]
    return Settings(
        folders=[folders] if isinstance(folders, str) else list(folders or []),
        index=raw["vectorstore_config"]["persist_directory"],
        chunk_size=cut.get("chunk_size", 800),
        chunk_overlap=cut.get("chunk_overlap", 100),
        candidates=find.get("candidate_top_k", 15),
        paraphrases=find.get("paraphrase_count", 3),
        alpha=find.get("hybrid_alpha", 0.5),
        chunks_per_file=find.get("chunks_per_file", 3),
        nearest=find.get("top_k", 4),
        embedding_model=find.get("embedding_model"),
        reformat=bool((raw.get("pdf_reading_config") or {}).get("use_llm_reformat", False)),
        model=model,
        synonyms=dict(raw.get("term_synonyms") or {}),
    )


def load(path: str = "config.yaml") -> Settings:
    import yaml

    with open(path, encoding="utf-8") as f:
        return parsed(yaml.safe_load(f))
