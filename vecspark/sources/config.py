"""Settings of the command line in a TOML file, and access keys as text. Keys are checked and shown, never stored."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PATH = Path.home() / ".vecspark" / "config.toml"
#: What the command line may do unless a settings file says otherwise.
FEATURES = {"benchmark_pretrained": True, "benchmark_with_train": True, "standalone_training": True}
#: Least length of a key, longest key that is hidden whole, characters shown in front and at the end.
KEY_LENGTH, HIDDEN_LENGTH, SHOWN_FIRST, SHOWN_LAST = 20, 12, 8, 4


@dataclass
class Config:
    """``default_model`` sets the output size of codecs where none is asked for; ``features`` switch commands."""

    default_model: str | None = None
    features: dict[str, bool] = field(default_factory=FEATURES.copy)

    @classmethod
    def load(cls, path: Path = DEFAULT_PATH) -> Config:
        """A missing file gives the defaults; unknown entries are an error."""
        own = tomllib.loads(path.read_text()) if path.exists() else {}
        config = cls(own.pop("default_model", None))
        for name, value in own.pop("features", {}).items():
            config.set(name, str(value))
        if own:
            raise ValueError(f"unknown settings in {path}: {', '.join(sorted(own))}")
        return config

    def save(self, path: Path = DEFAULT_PATH) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        model = [f"default_model = {json.dumps(self.default_model)}"] if self.default_model is not None else []
        path.write_text("\n".join([*model, "", "[features]", *[f"{k} = {str(v).lower()}" for k, v in self.features.items()], ""]))

    def items(self) -> dict[str, str | bool | None]:
        return {"default_model": self.default_model, **self.features}

    def set(self, name: str, value: str) -> None:
        name = name.replace("-", "_")
        if name == "default_model":
            self.default_model = value or None
        elif name in FEATURES and value.lower() in ("true", "false"):
            self.features[name] = value.lower() == "true"
        else:
            raise ValueError(f"no setting {name} = {value}")


def well_formed_key(key: Column, prefix: str) -> Column:
    return key.startswith(prefix) & (F.length(key) >= KEY_LENGTH)


def masked_key(key: Column) -> Column:
    """Stars for a short key, else its first and last characters."""
    ends = F.concat(F.substring(key, 1, SHOWN_FIRST), F.lit("..."), F.right(key, F.lit(SHOWN_LAST)))
    return F.when(F.length(key) <= HIDDEN_LENGTH, F.regexp_replace(key, r"(?s).", "*")).otherwise(ends)
