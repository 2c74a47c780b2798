"""Settings of a source tree, read from a JSON file; a wrong key is skipped with a warning."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

FILE_NAME = ".treeledger.json"


@dataclass(frozen=True)
class Settings:
    ignore: tuple[str, ...] = ()
    max_files: float | None = None
    summarizer: str = "ast"
    ages: dict[str, float] = field(default_factory=lambda: {"cacheMaxAgeDays": 30, "taskMaxAgeDays": 30, "telemetryMaxAgeDays": 90})
    groups: dict[str, bool] = field(default_factory=lambda: {"summaries": True, "tasks": False, "telemetry": False})


#: Operations of each group; those of no group are always there.
GROUPS = {
    "summaries": ("get_file_summary", "batch_file_summaries", "force_reread", "search_by_purpose", "invalidate"),
    "tasks": ("create_task", "get_task_context", "mark_explored"),
    "telemetry": ("get_token_report",),
}
ALWAYS = ("get_project_map", "get_related_files", "get_dependency_graph", "get_changed_files")


def operations(settings: Settings) -> tuple[str, ...]:
    """Names of the operations that the settings offer."""
    return ALWAYS + tuple(name for group, names in GROUPS.items() if settings.groups[group] for name in names)


def _positive(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 1


def parse_settings(raw: object) -> Settings:
    base = Settings()
    if not isinstance(raw, dict):
        warnings.warn("settings must be a JSON object; using defaults", stacklevel=2)
        return base
    kept: dict = {}

    def take(key: str, name: str, good: bool, value: object) -> None:
        if key in raw:
            if good:
                kept[name] = value
            else:
                warnings.warn(f"{key} is wrong; ignoring it", stacklevel=3)

    ignore = raw.get("ignore")
    take("ignore", "ignore", isinstance(ignore, list) and all(isinstance(x, str) for x in ignore), tuple(ignore) if isinstance(ignore, list) else ())
    take("maxFiles", "max_files", _positive(raw.get("maxFiles")), raw.get("maxFiles"))
    take("summarizer", "summarizer", raw.get("summarizer") in ("regex", "ast"), raw.get("summarizer"))
    for scope, name, check in (("gc", "ages", _positive), ("tools", "groups", lambda v: isinstance(v, bool))):
        found = raw.get(scope)
        if scope in raw and not isinstance(found, dict):
            warnings.warn(f"{scope} must be an object; ignoring it", stacklevel=2)
        elif scope in raw:
            known = getattr(base, name)
            wrong = [k for k in found if k in known and not check(found[k])]
            for k in wrong:
                warnings.warn(f"{scope}.{k} is wrong; ignoring it", stacklevel=2)
            kept[name] = known | {k: v for k, v in found.items() if k in known and k not in wrong}
    return Settings(**kept)


def load_settings(root: str) -> Settings:
    """Settings of a tree; defaults when the file is missing or unreadable."""
    path = Path(root, FILE_NAME)
    if not path.exists():
        return Settings()
    try:
        return parse_settings(json.loads(path.read_text("utf-8")))
    except (OSError, ValueError) as e:
        warnings.warn(f"{FILE_NAME} can't be read: {e}", stacklevel=2)
        return Settings()
