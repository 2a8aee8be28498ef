"""Import statements of sixteen languages, and where each may lead.

``parse`` gives (import, line) in source order; ``candidates`` gives the paths
that an import may stand for, best first, as (how, text): ``exact`` paths,
``suffix`` for any path that ends with the text (by characters, so ``Foo.swift``
also fits ``MyFoo.swift``), ``within`` for a Go file below a directory. Both are
pure functions of one statement or file, so they run on executors without state.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

Found = list[tuple[str, int]]
#: Language of each source extension. Fixed values.
LANGUAGE_OF = {"kt": "kotlin", "kts": "kotlin", "java": "java", "cs": "csharp", "dart": "dart", "go": "go", "hs": "haskell", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "rs": "rust", "swift": "swift", "zig": "zig", "php": "php", "rb": "ruby", "ex": "elixir", "exs": "elixir", "scala": "scala", "sc": "scala"}
_SLASHES = {"kotlin", "java", "csharp", "dart", "go", "javascript", "typescript", "rust", "swift", "zig", "php", "scala"}


def _blank(m: re.Match[str]) -> str:
    return "".join(c if c == "\n" else " " for c in m[0])


def without_comments(language: str, source: str) -> str:
    """The source with comments blanked, line for line; comment marks inside plain strings stay."""
    if language in _SLASHES:
        keep = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
        return re.sub(rf"({keep})|//[^\n]*|/\*.*?\*/", lambda m: m[0] if m[1] else _blank(m), source, flags=re.S)
    if language in ("python", "ruby", "elixir"):
        return re.sub(r"(\"\"\".*?\"\"\"|'''.*?''')|^[ \t]*#[^\n]*", _blank, source, flags=re.S | re.M)
    if language == "haskell":
        return re.sub(r"--[^\n]*|\{-.*?-\}", _blank, source, flags=re.S)
    return source


def _each(pattern: str, flags: int = re.M) -> Callable[[str], Found]:
    compiled = re.compile(pattern, flags)
    return lambda s: [(m[1], s.count("\n", 0, m.start(0) + len(m[0]) - len(m[0].lstrip())) + 1) for m in compiled.finditer(s)]


def _line(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def _dart(s: str) -> Found:
    return [x for x in _each(r"^[ \t]*(?:import|export)\s+['\"]([^'\"]+)['\"]")(s) if not x[0].startswith("dart:")]


def _go(s: str) -> Found:
    found = []
    for m in re.finditer(r"^[ \t]*import\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", s, re.M):
        if m[2]:
            found.append((m[2], _line(s, m.start(2))))
        else:
            found += [(x[1], _line(s, m.start(1) + x.start(1))) for x in re.finditer(r"\"([^\"]+)\"", m[1])]
    return found


def _python(s: str) -> Found:
    found = []
    for m in re.finditer(r"^[ \t]*(?:import[ \t]+([^\n;]+)|from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import\b)", s, re.M):
        line = _line(s, m.start() + len(m[0]) - len(m[0].lstrip()))
        if m[2] is not None:
            found.append((m[2].replace(" ", ""), line))
        else:  # renamed modules are no plain names
            found += [(x.strip(), line) for x in m[1].split("#")[0].split(",") if re.fullmatch(r"[\w.]+", x.strip())]
    return found


def _rust(s: str) -> Found:
    found = []
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s, re.M):
        line, text = _line(s, m.start() + len(m[0]) - len(m[0].lstrip())), re.sub(r"\s+", " ", m[1]).strip()
        if head := re.fullmatch(r"([\w:]+)::\{(.*)\}", text):
            for item in re.findall(r"(?:[^,{}]|\{[^{}]*\})+", head[2]):
                item = item.strip()
                if item == "self":
                    found.append((head[1], line))
                elif re.fullmatch(r"[\w:*]+", item):
                    found.append((f"{head[1]}::{item}", line))
        elif re.fullmatch(r"[\w:*]+", text):
            found.append((text, line))
    return found


def _php(s: str) -> Found:
    found = []
    for m in re.finditer(r"^[ \t]*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?(?:\\?\{([^}]*)\})?\s*;|\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]", s, re.M):
        line = _line(s, m.start() + len(m[0]) - len(m[0].lstrip()))
        if m[3]:
            found.append((m[3], line))
        elif m[2] is not None:
            found += [(m[1].rstrip("\\") + "\\" + x.split(" as ")[0].strip(), line) for x in m[2].split(",") if x.strip()]
        else:
            found.append((m[1], line))
    return found


def _elixir(s: str) -> Found:
    found = []
    for m in re.finditer(r"^[ \t]*(?:alias|import|use|require)\s+([A-Z][\w.]*?)(?:\.\{([^}]*)\})?(?=[\s,]|$)", s, re.M):
        line = _line(s, m.start() + len(m[0]) - len(m[0].lstrip()))
        found += [(f"{m[1]}.{x.strip()}", line) for x in m[2].split(",") if x.strip()] if m[2] else [(m[1], line)]
    return found


_SCRIPT = _each(r"^[ \t]*import\b(?:[^'\";]*?\bfrom)?\s*['\"]([^'\"]+)['\"]")
_PARSERS: dict[str, Callable[[str], Found]] = {
    "kotlin": _each(r"^[ \t]*import\s+([\w.]+?)(?:\.\*)?(?:\s+as\s+\w+)?[ \t]*;?[ \t]*$"),
    "java": _each(r"^[ \t]*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;"),
    "csharp": _each(r"^[ \t]*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"),
    "dart": _dart,
    "go": _go,
    "haskell": _each(r"^import\s+(?:qualified\s+)?([A-Z][\w.]*)"),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "python": _python,
    "rust": _rust,
    "swift": _each(r"^[ \t]*(?:@\w+\s+)?import\s+([^\n;]+?)[ \t]*;?[ \t]*$"),
    "zig": _each(r"@import\(\"([^\"]+)\"\)", 0),
    "php": _php,
    "ruby": _each(r"^[ \t]*(?:require|require_relative|load)[ \t]*\(?[ \t]*['\"]([^'\"]+)['\"]"),
    "elixir": _elixir,
    "scala": _each(r"^[ \t]*import\s+([^\n]+?)[ \t]*$"),
}


@dataclass(frozen=True)
class Adapter:
    """A further language, or another reading of a known one, for ``imports.extract`` and ``imports.scan``.

    ``parse`` takes a source text and gives (import, line); ``candidates`` takes
    an import and the file it stands in and gives (how, text). Both travel to
    the executors with the job, so nothing has to be registered there.
    """

    extensions: tuple[str, ...]
    parse: Callable[[str], Found]
    candidates: Callable[[str, str], list[tuple[str, str]]]


def adapters_by_extension(adapters: Iterable[Adapter]) -> dict[str, Adapter]:
    """The adapter of each extension, the last one if several claim it."""
    return {e: a for a in adapters for e in a.extensions}


def parse(extension: str, source: str) -> Found:
    """(import, line) of each import statement of a file, in order; nothing for unknown extensions."""
    language = LANGUAGE_OF.get(extension)
    return _PARSERS[language](without_comments(language, source)) if language else []


def fold(path: str) -> str:
    """A path with ``.`` and ``..`` resolved; ``..`` at the root is dropped."""
    out: list[str] = []
    for x in path.split("/"):
        if x == "..":
            out = out[:-1]
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


def _folder(path: str) -> str:
    return path.rpartition("/")[0]


def _beside(source: str, name: str) -> str:
    folder = _folder(source)
    return f"{folder}/{name}" if folder else name


def _shortened(dotted: str, endings: list[str]) -> list[tuple[str, str]]:
    full = dotted.replace(".", "/")
    names = [full, full.rpartition("/")[0]]
    return [("suffix", n + e) for n in names if n for e in endings]


def _rust_candidates(name: str, source: str) -> list[tuple[str, str]]:
    segments = [x for x in name.split("::") if x]
    head, rest = segments[0], segments[1:]
    folder = _folder(source).split("/") if _folder(source) else []
    leaf = source.rpartition("/")[2]
    if head == "crate":
        at = next((i for i in range(len(folder) - 1, -1, -1) if folder[i] == "src"), None)
        if at is None:
            return []
        base = folder[: at + 1]
    elif head in ("super", "self"):
        base = folder if leaf in ("mod.rs", "lib.rs", "main.rs") or head == "super" else [*folder, leaf.removesuffix(".rs")]
        ups = 0
        while segments and segments[0] == "super":
            ups, segments = ups + 1, segments[1:]
        if head == "super":
            rest = segments
            ups = ups - 1 + (leaf in ("mod.rs", "lib.rs"))
            base = base[: len(base) - ups] if ups else base
    else:
        return []
    found = []
    while rest:
        stem = "/".join([*base, *rest])
        found += [("exact", f"{stem}.rs"), ("exact", f"{stem}/mod.rs")]
        rest = rest[:-1]
    return found


def candidates(extension: str, name: str, source: str) -> list[tuple[str, str]]:
    """(how, text) of what an import in the file ``source`` may stand for, best first."""
    language = LANGUAGE_OF.get(extension)
    if language == "kotlin":
        return _shortened(name, [".kt", ".kts"])
    if language == "java":
        return _shortened(name, [".java"])
    if language == "csharp":
        return _shortened(name, [".cs"])
    if language == "dart":
        if name.startswith("package:"):
            rest = name.partition("/")[2]
            return [("suffix", f"lib/{rest}"), ("suffix", rest)] if rest else []
        return [("exact", _beside(source, name)), ("suffix", _beside(source, name))]
    if language == "go":
        return [("within", name), ("suffix", f"{name}.go")]
    if language == "haskell":
        return [("suffix", name.replace(".", "/") + ".hs")]
    if language in ("javascript", "typescript"):
        if not name.startswith("."):
            return []
        base = fold(_beside(source, name))
        return [("exact", f"{base}{join}{e}") for join in ("", "/index") for e in (".ts", ".tsx", ".js", ".jsx")]
    if language == "python":
        dots = len(name) - len(name.lstrip("."))
        stem = name.lstrip(".").replace(".", "/")
        if not dots:
            return [("suffix", f"{stem}.py"), ("suffix", f"{stem}/__init__.py")]
        folder = _folder(source).split("/") if _folder(source) else []
        base = "/".join(folder[: len(folder) - (dots - 1)] if dots > 1 else folder)
        return [("exact", f"{base}/{stem}.py"), ("exact", f"{base}/{stem}/__init__.py")] if stem else [("exact", f"{base}/__init__.py")]
    if language == "rust":
        return _rust_candidates(name, source)
    if language == "swift":
        return [("suffix", f"{name}.swift")]
    if language == "zig":
        return [] if name in ("std", "builtin") else [("exact", fold(_beside(source, name)))]
    if language == "php":
        path = name.replace("\\", "/")
        path = path if path.endswith(".php") else f"{path}.php"
        return [("suffix", path), ("exact", _beside(source, path)), ("suffix", _beside(source, path))]
    if language == "ruby":
        path = name if name.endswith(".rb") else f"{name}.rb"
        return [("exact", _beside(source, path)), ("suffix", _beside(source, path)), ("suffix", path)]
    if language == "elixir":
        stem = "/".join(re.sub(r"(?<!^)([A-Z])", r"_\1", x).lower() for x in name.split("."))
        return [("suffix", f"{stem}.ex"), ("suffix", f"{stem}.exs")]
    if language == "scala":
        stem = re.sub(r"\.?\{[^}]*\}|\.?_$|\.\*$", "", name).strip(". ").replace(".", "/")
        return [("suffix", f"{stem}.scala"), ("suffix", f"{stem}.sc")] if stem else []
    return []
