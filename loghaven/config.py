"""Settings: defaults, a JSON file over them, environment variables over both.

``.env`` and ``.env.local`` of a folder are read as environment variables, the later over
the earlier and both over the process's own. Times are numbers of seconds or texts such as
``90s``, ``5m``, ``1h30m`` or ``250ms``.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "LOGHAVEN_"
MAINNET = 1


@dataclass
class Config:
    """All settings; names with a dot in messages follow the sections of the file."""

    warehouse_root: str = ""
    warehouse_lock_dir: str = ""
    server_host: str = "0.0.0.0"
    server_port: int = 8545
    server_read_timeout: float = 30.0
    server_write_timeout: float = 120.0
    server_idle_timeout: float = 120.0
    debug: bool = False
    ethereum_url: str = ""
    ethereum_chain_id: int = MAINNET
    ethereum_ingestion_enabled: bool = True
    ethereum_confirmation_blocks: int = 2
    ethereum_max_catchup_blocks: int = 50_000
    ethereum_getlogs_span_cap: int = 10_000
    ethereum_start_block: int = -1
    ethereum_head_timeout: float = 300.0
    ethereum_rpc_timeout: float = 60.0
    rpc_max_results: int = 100_000
    rpc_query_timeout: float = 60.0


_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_DURATION = re.compile(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)")


def seconds(value: object) -> float:
    """Seconds of a number or of a text of numbers with units."""
    try:
        return float(value)
    except ValueError:
        parts = _DURATION.findall(str(value))
        if not parts or "".join(n + u for n, u in parts) != str(value):
            raise ValueError(f"invalid duration {value!r}") from None
        return sum(float(n) * _UNITS[u] for n, u in parts)


def _typed(kind: object, value: object) -> object:
    name = kind if isinstance(kind, str) else kind.__name__
    if name == "bool":
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
    return {"int": int, "float": seconds, "str": str}[name](value)


def env_file(path: Path) -> dict[str, str]:
    """Variables of a file of NAME=value lines; comments, quotes and ``export`` are understood."""
    found = {}
    if path.is_file():
        for line in path.read_text().splitlines():
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
                found[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return found


def load(path: str | None = None, env: dict[str, str] | None = None, env_dir: str | None = None) -> Config:
    """Read and check the settings."""
    env = dict(os.environ) if env is None else dict(env)
    if env_dir is not None:
        for name in (".env", ".env.local"):
            env |= env_file(Path(env_dir, name))
    values: dict[str, object] = {}
    if path:
        with open(path) as source:
            for section, inner in json.load(source).items():
                values |= {f"{section}_{k}": v for k, v in inner.items()} if isinstance(inner, dict) else {section: inner}
    config = Config()
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper(), values.get(f.name))
        if raw is not None:
            setattr(config, f.name, _typed(f.type, raw))
    validate(config)
    return config


def validate(c: Config) -> None:
    missing = [name for name, value in (("warehouse.root", c.warehouse_root), ("ethereum.url", c.ethereum_url or not c.ethereum_ingestion_enabled)) if not value]
    if missing:
        raise ValueError(f"missing required config: {', '.join(missing)}")
    if 0 < c.ethereum_max_catchup_blocks <= c.ethereum_confirmation_blocks:
        raise ValueError(f"ethereum.confirmation_blocks ({c.ethereum_confirmation_blocks}) must be below ethereum.max_catchup_blocks ({c.ethereum_max_catchup_blocks})")
    if c.ethereum_chain_id != MAINNET:
        raise ValueError(f"ethereum.chain_id must be {MAINNET}: stored rows do not name their chain, so only mainnet is kept")
    if c.rpc_max_results < 0:
        raise ValueError("rpc.max_results must be >= 0")
    if c.rpc_query_timeout <= 0:
        raise ValueError("rpc.query_timeout must be > 0, since no read of the warehouse may last forever")
