"""The records of the library as schemas, for readers and for tables that are made by hand."""

from __future__ import annotations

TRANSFER = "timestamp string, from_bank string, from_account string, to_bank string, to_account string, amount_received double, receiving_currency string, amount_paid double, payment_currency string, payment_format string, is_laundering int"
BLOCK = f"pattern_id string, file string, block bigint, raw string, typology string, transfers array<struct<place: bigint, {TRANSFER.replace(' ', ': ').replace(',:', ',')}>>"
EDGE = "src string, dst string, edge_key string"
CANDIDATE = "world bigint, length int, cycle array<bigint>, events array<bigint>"
RING = "ring bigint, place int, src string, dst string, time bigint, amount double"
NODE = "world bigint, node bigint, h array<double>"
BAR = "birth double, death double"
SCORE = "world string, candidate bigint, y int, s double"
