"""Training-data operators: toxicity, BPE, exact and near deduplication, search,
line and license scans, sharding and mixing.

Each module holds one operator with a general interface; ``queries`` binds the
operators to the tables of a corpus folder. Nothing outside this package imports it.
"""
