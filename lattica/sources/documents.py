"""Small documents that the driver reads and writes: metrics, registries, manifests, settings."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any


def read_json(path: str | Path) -> dict[str, Any]:
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def write_json(path: str | Path, value: Any) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_text(path: str | Path, text: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def registry_entry(file_name: str, ranking: bool = False) -> dict[str, Any]:
    """How a trainer reads a data set: chat format, and two answers where pairs are ranked."""
    columns = {"messages": "conversations"} | ({"chosen": "chosen", "rejected": "rejected"} if ranking else {}) | {"images": "images"}
    return {"file_name": file_name, "formatting": "sharegpt"} | ({"ranking": True} if ranking else {}) | {"columns": columns}


def registry(prefix: str) -> dict[str, Any]:
    """The six data sets, by a common prefix."""
    plain = {f"{prefix}_{n}": registry_entry(f"{prefix}_{n}.jsonl") for n in ("sft_train", "preference_pool", "val", "test")}
    pairs = {f"{prefix}_{n}": registry_entry(f"{prefix}_{n}.jsonl", True) for n in ("badcase_preference", "base_badcase_preference")}
    return plain | pairs


def register(path: str | Path, name: str, file_name: str) -> None:
    """Add or replace one entry; the file is made if need be."""
    found = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    write_json(path, found | {name: registry_entry(file_name)})


def run_manifest(settings: dict[str, Any], sources: dict[str, str], outputs: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """What a conversion was made from and what came out; outputs: count, verdicts and labels of each."""
    guard = "preference data comes only from the official train split; val/test are evaluation-only"
    return settings | {"source": {k: str(Path(v).resolve()) for k, v in sources.items()}, "outputs": outputs, "leakage_guard": guard}


def reward_manifest(sources: dict[str, str], weights: dict[str, float], counts: dict[str, int], samples: int, parts: dict[str, float]) -> dict[str, Any]:
    """What a reward was made of: where its data came from, cases, their weights and the formula."""
    formula = " + ".join(f"{share} {name}" for name, share in parts.items())
    return sources | {"case_counts": dict(sorted(counts.items())), "case_weights": dict(sorted(weights.items())), "num_samples": samples, "reward": f"weight * ({formula}) - penalty"}


def overrides(items: list[str]) -> dict[str, str]:
    """KEY=VALUE texts; the last of a key holds."""
    found = {}
    for item in items:
        key, eq, value = item.partition("=")
        if not eq or not key.strip():
            raise ValueError(f"not KEY=VALUE: {item}")
        found[key.strip()] = value.strip()
    return found


def patch_settings(text: str, changes: dict[str, str]) -> str:
    """Replace top-level keys of a YAML text, each once; keys it lacks are added under a comment."""
    missing = dict(changes)

    def renew(m: re.Match) -> str:
        key = m[1].strip()
        return f"{key}: {missing.pop(key)}" if key in missing else m[0]

    body = re.sub(r"^(?![ \t#])([^:\n]*):.*$", renew, "\n".join(text.splitlines()), flags=re.MULTILINE)
    added = "".join(f"\n{k}: {v}" for k, v in missing.items())
    return body + (f"\n\n### runtime overrides{added}" if added else "") + "\n"


def report_targets(text: str) -> str | list[str]:
    """none, no and false are no target; a comma makes a list."""
    if text.lower() in ("none", "no", "false"):
        return []
    return [p.strip() for p in text.split(",") if p.strip()] if "," in text else text
