"""The stored tables."""

SCHEMAS = {
    "genes": "gene_id int, gene_name string",
    "cells": "cell_id int, cell_name string",
    "counts": "cell_id int, gene_id int, count float",
    "cell_meta": "cell_id int, name string, value string, ord int",
    "gene_meta": "gene_id int, name string, value string, ord int",
    "cell_sets": "set_name string, cell_id int",
    "gene_sets": "set_name string, gene_id int",
    "similar_pairs": "name string, id0 bigint, id1 bigint, similarity double, rank int",
    "similar_gene_pairs": "name string, id0 bigint, id1 bigint, similarity double, rank int",
    "signatures": "name string, id bigint, sig array<bigint>",
    "vertices": "name string, id bigint, cluster_id bigint",
    "edges": "name string, src bigint, dst bigint, similarity double",
    "profiles": "name string, cluster_id bigint, gene_id int, average double",
    "positions": "name string, id bigint, x double, y double",
    "catalog": "kind string, name string, params map<string,string>",
}
NORMALISATIONS = ("none", "L1", "L2")
