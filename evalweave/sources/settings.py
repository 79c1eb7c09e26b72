"""Settings read on the driver: YAML or JSON files of a few lines, with variables and relative paths resolved."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

_VARIABLE = re.compile(r"\$\{([^}]+)\}")


def expand(value, variables: Mapping[str, str] | None = None):
    """value with ${NAME} replaced in every text inside; a name that is not set stays as it is."""
    known = os.environ if variables is None else variables
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: known.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand(v, known) for k, v in value.items()}
    return [expand(v, known) for v in value] if isinstance(value, list) else value


def load(path: str, paths: tuple[str, ...] = (), variables: Mapping[str, str] | None = None) -> dict:
    """A file's settings. `paths` names dotted fields that are relative to the file's folder; a missing one is passed over."""
    file = Path(path).resolve()
    text = file.read_text(encoding="utf-8-sig")
    if file.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML settings need the yaml package; JSON ones do not") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{file}: settings are an object")
    found = expand(found, variables)
    for name in paths:
        *folders, last = name.split(".")
        at = found
        for f in folders:
            at = at.get(f, {})
        if isinstance(at.get(last), str):
            at[last] = str((file.parent / at[last]).resolve())
    return found
