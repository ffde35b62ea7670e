"""Training-data operators: search, formatting, mixing, filtering, deduplication, identification, sharding,
archives, decontamination and language-model scoring. Nothing else in the library imports this subpackage."""
