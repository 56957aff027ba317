"""Small configuration files: aliases, stop concepts, taxonomy, interests."""

from __future__ import annotations

import os


def _load(path: str):
    import yaml

    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def load_aliases(path: str) -> dict[str, str]:
    """Alias to canonical name; a missing or empty file has none."""
    data = _load(path)
    data = data.get("aliases", data) if isinstance(data, dict) else {}
    return {str(k): str(v) for k, v in data.items()} if isinstance(data, dict) else {}


def load_stop_concepts(path: str) -> set[str]:
    data = _load(path)
    if isinstance(data, dict):
        data = next((v for v in data.values() if isinstance(v, list)), [])
    return {str(x) for x in data} if isinstance(data, list) else set()


def load_taxonomy(path: str) -> dict[str, dict]:
    """Collections by name, each with its concepts and types."""
    data = _load(path)
    data = data.get("collections", data) if isinstance(data, dict) else {}
    return {str(k): v for k, v in data.items() if isinstance(v, dict)} if isinstance(data, dict) else {}


def load_interests(path: str) -> set[str]:
    data = _load(path)
    if isinstance(data, dict):
        data = data.get("interests") or []
    return {str(x).lower() for x in data} if isinstance(data, list) else set()
