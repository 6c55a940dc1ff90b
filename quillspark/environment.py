"""The surroundings: optional packages, the project's folder and commit."""

from __future__ import annotations

import importlib
import importlib.util
import subprocess
from pathlib import Path
from types import ModuleType

#: Packages beyond Spark's own, and what needs them.
OPTIONAL = {
    "ahocorasick": "benchmark decontamination (package pyahocorasick)",
    "tiktoken": "token counts",
    "public_tokenizers": "the default vocabulary of token counts (pass ranks_path instead)",
    "duckdb": "bench.py and the tests' comparison with SQL",
}


def is_available(module: str) -> bool:
    return importlib.util.find_spec(module) is not None


def require(module: str) -> ModuleType:
    """The module, or an ImportError that says what it is needed for."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{module!r} is not installed; needed for {OPTIONAL.get(module, 'this function')}") from e


def project_root(start: str | Path | None = None, marker: str = ".git") -> Path | None:
    """The nearest folder from ``start`` upwards that holds ``marker``."""
    here = Path(start or Path.cwd()).resolve()
    return next((p for p in (here, *here.parents) if (p / marker).exists()), None)


def commit_hash(folder: str | Path | None = None) -> str | None:
    """The commit checked out in ``folder``; None outside of a repository."""
    try:
        said = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, timeout=20)
    except OSError:
        return None
    return said.stdout.strip() or None if said.returncode == 0 else None
