"""Content hashes. Equal content gives equal hashes; bytes are our own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_hash(**fields: Column) -> Column:
    """Hash of named values, independent of the order they are given in."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def group_hash(rows: Column) -> Column:
    """Hash of an array of structs, independent of row order."""
    return F.sha2(F.to_json(F.array_sort(rows), {"ignoreNullFields": "false"}), 256)


def place_hash(name: Column, city: Column, address: Column, rating: Column, reviews: Column) -> Column:
    return stable_hash(name=name, city=city, address=address, rating=rating, reviews=reviews)
