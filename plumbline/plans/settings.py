"""Audit settings, and globs as regular expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Weight of each dependency direction. Fixed values.
DIRECTION_WEIGHTS = {"downward": 2.0, "sibling": 4.0, "upward": 6.0, "external": 8.0, "transitive": 9.0, "circular": 10.0}
#: What discovery skips, and the source extensions it keeps. Fixed values.
IGNORED = ["**/.git/**", "**/target/**", "**/node_modules/**", "**/.plumbline/**", "**/.agent/**", "**/build/**", "**/dist/**", "**/.gradle/**", "**/__pycache__/**", "**/.venv/**", "**/zig-cache/**", "**/zig-out/**", "**/generated/**", "**/.idea/**", "**/.vscode/**"]
EXTENSIONS = ["kt", "kts", "java", "cs", "dart", "go", "hs", "js", "jsx", "ts", "tsx", "py", "rs", "swift", "zig", "php", "rb", "ex", "exs", "scala", "sc"]


def glob_to_regex(glob: str) -> str | None:
    """A regular expression for a whole path; None if the glob is malformed.

    ``*`` and ``?`` cross ``/``; ``**/`` also stands for nothing, so a pattern
    that starts with it matches at the root; ``[...]`` and ``{a,b}`` work.
    """
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.*", i + 3
        elif c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out, i = out + ".*", i + 1
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}":
            if not depth:
                return None
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return None if depth else f"^{out}$"


@dataclass
class Layer:
    name: str
    pattern: str
    allow_sibling: bool = False
    reduced_sibling_weight: float = 2.5


@dataclass
class Rule:
    source: str
    target: str
    allow: bool = False
    message: str | None = None


@dataclass
class ModuleConfig:
    name: str
    path: str
    depends_on: list[str] = field(default_factory=list)


@dataclass
class Settings:
    """Parameters of an audit; a partial JSON file fills up with defaults."""

    min_severity: float = 0.2
    critical_severity: float = 0.5
    green_score: float = 90.0
    yellow_score: float = 70.0
    ignore_patterns: list[str] = field(default_factory=lambda: list(IGNORED))
    source_extensions: list[str] = field(default_factory=lambda: list(EXTENSIONS))
    dependency_rules: list[Rule] = field(default_factory=list)
    layers: list[Layer] = field(default_factory=list)
    allow_inline_suppression: bool = True
    modules: list[ModuleConfig] = field(default_factory=list)
    risk_weights: dict[str, float] = field(default_factory=lambda: dict(DIRECTION_WEIGHTS))
    coupling_mode: str = "strict"

    @classmethod
    def load(cls, path: str | Path) -> Settings:
        """Settings from a JSON file; defaults if there is none. A top-level coupling_mode overrides that of the thresholds."""
        if not Path(path).exists():
            return cls()
        raw = json.loads(Path(path).read_text())
        limits = raw.get("thresholds", {})
        known = {ours: limits[theirs] for ours, theirs in _THRESHOLDS.items() if theirs in limits}
        for name in ("ignore_patterns", "source_extensions", "allow_inline_suppression", "coupling_mode"):
            if raw.get(name) is not None:
                known[name] = raw[name]
        known["risk_weights"] = DIRECTION_WEIGHTS | raw.get("risk_weights", {})
        known["dependency_rules"] = [Rule(x["from"], x["to"], x["allow"], x.get("message") or None) for x in raw.get("dependency_rules", [])]
        known["layers"] = [Layer(**{k: v for k, v in x.items() if k in Layer.__dataclass_fields__}) for x in raw.get("layers", [])]
        known["modules"] = [ModuleConfig(**x) for x in raw.get("modules", [])]
        return cls(**known)

    def save(self, path: str | Path) -> None:
        raw = asdict(self)
        raw["thresholds"] = {theirs: raw.pop(ours) for ours, theirs in _THRESHOLDS.items()}
        raw["dependency_rules"] = [{"from": r.source, "to": r.target, "allow": r.allow, "message": r.message or ""} for r in self.dependency_rules]
        Path(path).write_text(json.dumps(raw, indent=2))


#: Where the thresholds stand in the file.
_THRESHOLDS = {"green_score": "score_green", "yellow_score": "score_yellow", "critical_severity": "critical_severity", "min_severity": "minimum_severity", "coupling_mode": "coupling_mode"}
