"""Settings: JSON with ${NAME} from the environment, overrides by variables, and lookups with a default."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping

_VARIABLE = re.compile(r"\$\{(\w+)\}|\$(\w+)")


def expand(text: str, env: Mapping[str, str] | None = None) -> str:
    """Variables of the environment in place; unset ones become nothing."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1] or m[2], ""), text)


def first_set(*names: str, env: Mapping[str, str] | None = None, default: str = "") -> str:
    """The first of the variables that isn't blank, trimmed."""
    env = os.environ if env is None else env
    return next((v for n in names if (v := env.get(n, "").strip())), default)


def load(path: str, env: Mapping[str, str] | None = None) -> dict:
    with open(path) as f:
        return json.loads(expand(f.read(), env))


def bucket(buckets: Mapping[str, str] | None, name: str, default: str) -> str:
    """A named bucket; blank and unknown names and 'default' mean the default one."""
    key = name.strip().lower()
    found = "" if key in ("", "default") else ((buckets or {}).get(key) or "").strip()
    return found or default.strip()
