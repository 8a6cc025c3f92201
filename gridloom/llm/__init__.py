"""Operators that prepare training data: near-dedup, licences, personal data,
token files, quality, web archives, secrets, packing, sharding and
decontamination.  Nothing outside this subpackage imports it."""
