"""Settings in layers: arguments, then ``GLYPHMILL_*`` variables, then ``glyphmill.toml``, then defaults."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .functions.text import FORMS
from .operators.render import FORMATS

FILE, PREFIX = "glyphmill.toml", "GLYPHMILL_"
MAX_BYTES = 100 * 1024 * 1024
UNSET: Any = object()  # an argument that was not given; None is a value for encoding and ocr


@dataclass(frozen=True, slots=True)
class Settings:
    output: str = "markdown"
    encoding: str | None = None
    ocr: bool | None = None
    normalize: str = "NFC"
    max_bytes: int = MAX_BYTES

    def __post_init__(self) -> None:
        for key, allowed in (("output", FORMATS), ("normalize", FORMS)):
            if getattr(self, key) not in allowed:
                raise ConfigError(f"{key}: {getattr(self, key)!r} is none of {', '.join(allowed)}")
        if not (self.encoding is None or isinstance(self.encoding, str)):
            raise ConfigError(f"encoding: a string is needed, not {self.encoding!r}")
        if not (self.ocr is None or isinstance(self.ocr, bool)):
            raise ConfigError(f"ocr: true or false is needed, not {self.ocr!r}")
        if isinstance(self.max_bytes, bool) or not isinstance(self.max_bytes, int) or self.max_bytes < 1:
            raise ConfigError(f"max_bytes: a positive whole number is needed, not {self.max_bytes!r}")


KEYS = tuple(asdict(Settings()))


def _from_file(folder: Path) -> dict[str, Any]:
    path = folder / FILE
    if not path.is_file():
        return {}
    try:
        data = tomllib.loads(path.read_text("utf-8"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    tool = data.pop("tool", {})
    own = tool.get("glyphmill") if isinstance(tool, dict) else None
    if isinstance(own, dict):
        if data:
            raise ConfigError(f"{path}: settings both under [tool.glyphmill] and at the top: {', '.join(sorted(data))}")
        data = own
    if unknown := sorted(set(data) - set(KEYS)):
        raise ConfigError(f"{path}: unknown settings: {', '.join(unknown)}")
    return data


def _from_environment(env: Mapping[str, str]) -> dict[str, Any]:
    found: dict[str, Any] = {k: env[PREFIX + k.upper()] for k in KEYS if PREFIX + k.upper() in env}
    if isinstance(ocr := found.get("ocr"), str):
        word = ocr.strip().lower()
        if word not in ("true", "1", "yes", "on", "false", "0", "no", "off"):
            raise ConfigError(f"ocr: true or false is needed, not {ocr!r}")
        found["ocr"] = word in ("true", "1", "yes", "on")
    if isinstance(size := found.get("max_bytes"), str):
        try:
            found["max_bytes"] = int(size)
        except ValueError:
            raise ConfigError(f"max_bytes: a whole number is needed, not {size!r}") from None
    return found


def load_settings(folder: Path | None = None, env: Mapping[str, str] | None = None) -> Settings:
    return Settings(**(_from_file(folder or Path.cwd()) | _from_environment(os.environ if env is None else env)))


def resolve(settings: Settings | None, **given: Any) -> Settings:
    """The settings with the arguments that were given on top."""
    return replace(settings or load_settings(), **{k: v for k, v in given.items() if v is not UNSET})
