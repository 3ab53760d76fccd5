"""Configuration (O04, O05): a TOML file over defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    model: str = ""
    api_key: str = ""
    base_url: str = ""
    max_tokens: int = 8192
    temperature: float = 0.8
    chunk_size: int = 100
    overlap: int = 20
    standardize: bool = True
    model_for_entities: bool = True
    infer: bool = True
    model_for_inference: bool = True
    apply_transitive: bool = True
    edge_smooth: str | bool = False

    def without(self, standardize: bool = False, infer: bool = False) -> Config:
        return replace(self, standardize=self.standardize and not standardize, infer=self.infer and not infer)


#: Section and key of each field in the file.
KEYS = {
    "model": ("llm", "model"),
    "api_key": ("llm", "api_key"),
    "base_url": ("llm", "base_url"),
    "max_tokens": ("llm", "max_tokens"),
    "temperature": ("llm", "temperature"),
    "chunk_size": ("chunking", "chunk_size"),
    "overlap": ("chunking", "overlap"),
    "standardize": ("standardization", "enabled"),
    "model_for_entities": ("standardization", "use_llm_for_entities"),
    "infer": ("inference", "enabled"),
    "model_for_inference": ("inference", "use_llm_for_inference"),
    "apply_transitive": ("inference", "apply_transitive"),
    "edge_smooth": ("visualization", "edge_smooth"),
}


def load_config(path: str = "config.toml") -> Config | None:
    """None if the file can't be read or parsed, whatever the reason; the reason is printed."""
    try:
        with open(path, "rb") as f:
            data = tomllib.load(f)
        return Config(**{k: data[s][n] for k, (s, n) in KEYS.items() if n in data.get(s, {})})
    except Exception as e:  # noqa: BLE001  a file of any other kind is no configuration
        print(f"{path}: {e}")
        return None
