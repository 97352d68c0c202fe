"""Parameters of a run."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_mapq: int = 20
    min_read_len: int = 500
    max_split_parts: int = 7  # -1: no limit
    min_siglength: int = 30
    merge_gap: int = 30
    min_size: int = 50
    max_size: int = 100_000  # -1: no limit
    min_support: int = 10
    gap_indel: int = 1000
    gap_dup_inv: int = 500
    gap_tra: int = 50
    len_ratio: float = 0.9
    max_cluster: int = -1  # signals of a cluster beyond which a job fails; -1: no limit
