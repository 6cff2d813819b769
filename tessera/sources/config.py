"""Configuration of a store: KEY=VALUE text, and the sizes that follow from it."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a key and of a page pointer, per-page and per-record overheads of the page format (fixed values).
KEY_BYTES, POINTER_BYTES, PAGE_HEAD, PAGE_TAIL, RECORD_OVERHEAD = 8, 9, 8, 18, 16


@dataclass(frozen=True)
class StoreConfig:
    """Names are the configuration keys in lower case; defaults are fixed values."""

    data_prefix: str = ""
    rnode_size: int = 4096
    snode_size: int = 4
    fanout: int = 4
    mem_use: int = -1
    only_largest: bool = False
    probablistic_merge: bool = False
    bloom_bpe: int = 7
    use_bloom_filters: bool = False
    max_val_size: int = 128
    merge_in_background: bool = False
    buffer_size: int = 0
    bytes_per_second: int = 110 << 20

    @property
    def memory(self) -> int:
        """Bytes for both memtables."""
        return self.mem_use if self.mem_use >= 0 else self.rnode_size * (self.snode_size - 1) * 2 * 12 // 10

    @property
    def memtable_bytes(self) -> int:
        return 9 * self.memory // 20

    @property
    def epoch_rows(self) -> int:
        """Inserts after which a memtable is flushed."""
        return math.ceil(self.memtable_bytes / (self.max_val_size + RECORD_OVERHEAD))

    @property
    def page_rows(self) -> int:
        """Records of a full leaf page: one more would leave no room for the next."""
        return math.ceil((self.rnode_size - 4) / (KEY_BYTES + self.max_val_size)) - 1

    @property
    def page_children(self) -> int:
        """Children of a full inner page: its keys and one."""
        return math.ceil((self.rnode_size - 4 - KEY_BYTES - PAGE_TAIL) / (KEY_BYTES + POINTER_BYTES)) + 1

    @property
    def node_rows(self) -> int:
        """Records of a node at its capacity in pages."""
        return self.page_rows * self.snode_size

    @property
    def bloom_entries(self) -> int:
        return self.snode_size * self.rnode_size // (KEY_BYTES + self.max_val_size)

    @property
    def bloom_bits(self) -> int:
        return self.bloom_entries * self.bloom_bpe

    @property
    def bloom_hashes(self) -> int:
        return math.ceil(math.log(2) * self.bloom_bpe)

    @property
    def bloom_error(self) -> float:
        return (1 - math.exp(-self.bloom_hashes / self.bloom_bpe)) ** self.bloom_hashes

    @classmethod
    def parse(cls, text: str) -> StoreConfig:
        """Lines of KEY=VALUE in any letter case; blank lines and lines that begin with # are skipped."""
        kinds = {f.name: f.type for f in fields(cls)}
        found = {}
        for number, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line.startswith("#"):
                continue
            name, is_pair, value = (x.strip() for x in line.partition("="))
            name = name.lower()
            if not is_pair or name not in kinds:
                raise ValueError(f"line {number}: {line!r}")
            found[name] = value if kinds[name] == "str" else value.lower() in ("1", "true", "yes") if kinds[name] == "bool" else int(value)
        return cls(**found)

    @classmethod
    def load(cls, path: str) -> StoreConfig:
        return cls.parse(Path(path).read_text())

    def frame(self, spark: SparkSession) -> DataFrame:
        """name, value of every setting."""
        return spark.createDataFrame([(k.upper(), str(v).lower() if isinstance(v, bool) else str(v)) for k, v in asdict(self).items()], "name string, value string")
