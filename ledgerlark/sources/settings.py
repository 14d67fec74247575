"""Settings from a TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from ..model import DEFAULT_LIMIT, DEFAULT_RANGE

# What settings may be.
FORMATS = ("xdr", "binary")
LEDGER_FORMATS = ("close_meta", "framed")
COMPRESSIONS = ("none", "snappy", "lz4", "zstd")


@dataclass
class Settings:
    ledger_dir: str = ""
    store_path: str = ""
    network: str = ""
    network_passphrase: str = ""
    event_format: str = "xdr"
    ledger_format: str = "close_meta"
    compression: str = "zstd"
    max_ledger_range: int = DEFAULT_RANGE
    default_limit: int = DEFAULT_LIMIT
    #: Chunks of ledgers a job of ingest.
    batch_size: int = 100
    final_compaction: bool = True
    indexes: dict[str, bool] = field(default_factory=lambda: {"contract": True, "topics": True})
    exclude_topic0: list[str] = field(default_factory=list)
    progress_file: str = ""

    def validate(self) -> Settings:
        missing = [n for n in ("ledger_dir", "store_path", "network") if not getattr(self, n)]
        if missing:
            raise ValueError(f"settings lack {', '.join(missing)}")
        if self.event_format not in FORMATS:
            raise ValueError(f"event_format must be one of {FORMATS}")
        if self.ledger_format not in LEDGER_FORMATS:
            raise ValueError(f"ledger_format must be one of {LEDGER_FORMATS}")
        return self

    @property
    def parquet_compression(self) -> str:
        """An unknown name means lz4."""
        return self.compression if self.compression in COMPRESSIONS else "lz4"


#: Where each setting stands in the file: section and key.
PLACES = {
    "ledger_dir": ("source", "ledger_dir"), "ledger_format": ("source", "ledger_format"), "network": ("source", "network"), "network_passphrase": ("source", "network_passphrase"),
    "store_path": ("storage", "db_path"), "event_format": ("storage", "event_format"), "compression": ("storage", "compression"),
    "max_ledger_range": ("query", "max_ledger_range"), "default_limit": ("query", "default_limit"),
    "batch_size": ("ingestion", "batch_size"), "final_compaction": ("ingestion", "final_compaction"), "progress_file": ("ingestion", "progress_file"),
    "exclude_topic0": ("ingestion", "exclude_topic0"),
}


def load(path: str) -> Settings:
    with open(path, "rb") as f:
        given = tomllib.load(f)
    out = Settings()
    for name, (section, key) in PLACES.items():
        if key in given.get(section, {}):
            setattr(out, name, given[section][key])
    out.indexes |= given.get("indexes", {})
    return out


def find(path: str | None = None) -> str | None:
    """``path`` if given, else ``config.toml`` here if there is one."""
    return path or ("config.toml" if os.path.exists("config.toml") else None)
