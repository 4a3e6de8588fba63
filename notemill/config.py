"""Configuration of a vault: a frozen dataclass, read from and written as YAML."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml

from .operators.index import FIELD_WEIGHTS

MARKER = ".notemill"
CONFIG_FILE = "config.yaml"
# What the reference leaves out of a vault, with this package's own folder.
EXCLUDE = [
    ".git/**", f"{MARKER}/**", ".obsidian/**", ".agents/**", ".claude/**", ".trash/**", "node_modules/**", "AGENTS.md", "CLAUDE.md",
]


@dataclass(frozen=True)
class VaultConfig:
    root: str
    exclude: tuple[str, ...] = tuple(EXCLUDE)
    extensions: tuple[str, ...] = (".md", ".markdown")
    k1: float = 1.2
    b: float = 0.75
    field_weights: dict[str, float] = field(default_factory=lambda: dict(FIELD_WEIGHTS))
    split_threshold_words: int = 1200
    filterable_frontmatter: tuple[str, ...] | None = None

    @property
    def home(self) -> str:
        return os.path.join(self.root, MARKER)


def find_root(start: str) -> str | None:
    """The nearest folder at or above `start` that holds the marker folder."""
    at = os.path.abspath(start)
    while not os.path.isdir(os.path.join(at, MARKER)):
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up
    return at


def load(root: str) -> VaultConfig:
    """The vault's configuration; missing, unreadable and ill-typed keys keep their defaults."""
    root = os.path.abspath(root)
    try:
        with open(os.path.join(root, MARKER, CONFIG_FILE), encoding="utf-8") as f:
            doc = yaml.safe_load(f)
    except (OSError, yaml.YAMLError):
        doc = None
    doc = doc if isinstance(doc, dict) else {}
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    texts = lambda k: tuple(map(str, doc[k])) if isinstance(doc.get(k), list) else None
    bm25 = doc["bm25"] if isinstance(doc.get("bm25"), dict) else {}
    weights = doc["field_weights"] if isinstance(doc.get("field_weights"), dict) else {}
    given = {
        "exclude": texts("exclude"),
        "extensions": (e := texts("extensions")) and tuple(x.lower() for x in e),
        "k1": float(bm25["k1"]) if number(bm25.get("k1")) else None,
        "b": float(bm25["b"]) if number(bm25.get("b")) else None,
        "field_weights": FIELD_WEIGHTS | {str(k): float(v) for k, v in weights.items() if number(v)},
        "split_threshold_words": doc["split_threshold_words"] if type(doc.get("split_threshold_words")) is int else None,
        "filterable_frontmatter": texts("filterable_frontmatter"),
    }
    return VaultConfig(root, **{k: v for k, v in given.items() if v is not None})


def render(c: VaultConfig) -> str:
    """The configuration as commented YAML, which `load` reads back."""
    notes = {
        "exclude": "Globs of files and folders that are no notes.",
        "extensions": "Extensions of notes, in lower case.",
        "bm25": "Ranking: saturation k1 and length normalisation b.",
        "field_weights": "What one occurrence of a term counts in each field.",
        "split_threshold_words": "Notes with more words are reported as oversized.",
        "filterable_frontmatter": "Only these front matter keys can be filtered on; without this key, all.",
    }
    doc = {
        "exclude": list(c.exclude),
        "extensions": list(c.extensions),
        "bm25": {"k1": c.k1, "b": c.b},
        "field_weights": dict(c.field_weights),
        "split_threshold_words": c.split_threshold_words,
    }
    if c.filterable_frontmatter is not None:
        doc["filterable_frontmatter"] = list(c.filterable_frontmatter)
    return "\n".join(f"# {notes[k]}\n{yaml.safe_dump({k: v}, sort_keys=False)}" for k, v in doc.items())


def save(c: VaultConfig) -> str:
    os.makedirs(c.home, exist_ok=True)
    at = os.path.join(c.home, CONFIG_FILE)
    with open(at, "w", encoding="utf-8") as f:
        f.write(render(c))
    return at
