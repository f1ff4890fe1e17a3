"""How to merge: one flat, written-down set of settings."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from tabweave.sources import storage


@dataclass
class MergeSettings:
    paths: list[str] = field(default_factory=list)
    agreement_method: str = "simple-count"
    coerce_schema_column_types: bool = False
    column_aliases: str | None = None
    column_alignment_threshold: float = 0.5
    column_name_semantic_alignment: bool = False
    column_names_hints: str | None = None
    column_value_semantic_alignment: bool = False
    drop_empty_columns: bool = True
    drop_empty_tables: bool = True
    filter_schema_columns: bool = False
    filter_title_rows: bool = True
    fix_reversed_column_values: bool = False
    hints_column_alignment: str | None = None  # safe or unsafe
    jaccard_column_alignment: bool = False
    normalize_punctuation: bool = False
    only_semantic_columns: bool = False
    order_schema_columns: bool = False
    paper_aliases: str | None = None
    pretty: bool = False
    remove_header_rows: bool = False
    schema: str | None = None
    semantic_language: str = "en"
    split_conjunction_columns: bool = False
    strip_leading_row_numbers: bool = False
    transform_tablesfile: str | None = None  # explode, safe-compact or unsafe-compact

    @classmethod
    def from_dict(cls, data: dict) -> MergeSettings:
        """Settings of a file; what this version doesn't know is left out."""
        return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data})

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def read(cls, path: str) -> MergeSettings:
        return cls.from_dict(json.loads(storage.read_text(path)))

    def write(self, path: str) -> None:
        storage.write_text(path, json.dumps(self.to_dict(), ensure_ascii=False, indent=2))

    def check(self) -> None:
        """Raises where a flag lacks what it works with."""
        for flag in ("filter_schema_columns", "order_schema_columns", "coerce_schema_column_types", "column_name_semantic_alignment"):
            if getattr(self, flag) and not self.schema:
                raise ValueError(f"{flag} needs a schema")
        if self.hints_column_alignment and not self.column_names_hints:
            raise ValueError("hints_column_alignment needs column_names_hints")
        if self.hints_column_alignment not in (None, "safe", "unsafe"):
            raise ValueError("hints_column_alignment is safe or unsafe")
        if self.agreement_method not in ("simple-count", "distinct-readers"):
            raise ValueError(f"unknown agreement method: {self.agreement_method}")
        if self.transform_tablesfile not in (None, "explode", "safe-compact", "unsafe-compact"):
            raise ValueError(f"unknown transformation: {self.transform_tablesfile}")
