"""Training-data operators: whole-corpus deduplication, decontamination,
counting, scoring, mixing, sharding and scanning. Nothing outside this
subpackage imports it."""
