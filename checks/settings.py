"""Parameters shared by the registered queries and their SQL.

They keep the carving at one level on the test tables, where the partition can
be written as plain SQL; ``DEEP`` recurses, and its SQL is unrolled by level.
"""

from nearfield.params import BuildParams, CarveParams, PruneParams, SearchParams
from nearfield.plans.experiments import SweepConfig

DIM = 64
K = 10
CARVE = CarveParams(cmax=128, leader_frac=0.02, fanout=2, max_leaders=1000, seed=17)
DEEP = CarveParams(cmax=64, leader_frac=0.02, fanout=3, max_leaders=1000, seed=17)
PRUNE = PruneParams(hash_bits=6, max_degree=16, seed=7)
BUILD = BuildParams(carve=CARVE, prune=PRUNE, replicas=1, leaf_k=12)
REPLICATED = BuildParams(carve=CARVE, prune=PRUNE, replicas=2, leaf_k=12)
SEARCH = SearchParams(beam=48, topk=K, entry=0)
SHORT_SEARCH = SearchParams(beam=6, topk=K, entry=0)
SCAN_CAP = 20
CELL_SEED, CELL_RECALL, CELL_SAMPLE, CELL_FACTORS = 17, 0.92, 256, (1, 2, 4, 8, 16, 32)
ROW_LIMIT = 100
SYNTHETIC_SEED = 42
#: A second partition setting of one level, with other sizes and without overlap.
FINER = CarveParams(cmax=64, leader_frac=0.04, fanout=1, max_leaders=1000, seed=23)
SWEEP = [
    SweepConfig("refined_k6_deg8", leaf_k=6, max_degree=8, beam=24),
    SweepConfig("refined_k12_deg16", leaf_k=12, max_degree=16, beam=32),
    SweepConfig("hash_k12_deg16", leaf_k=12, max_degree=16, beam=32, mode="hash"),
    SweepConfig("finer_refined", leaf_k=12, max_degree=16, beam=32, carve=FINER),
    SweepConfig("finer_hash_bits4", leaf_k=12, max_degree=16, beam=32, mode="hash", carve=FINER, replicas=2, hash_bits=4),
]
RUNS = [
    SweepConfig("refined_k4", leaf_k=4, max_degree=16),
    SweepConfig("refined_k8", leaf_k=8, max_degree=16),
    SweepConfig("refined_k12", leaf_k=12, max_degree=16),
    SweepConfig("hash_k4", leaf_k=4, max_degree=16, mode="hash"),
    SweepConfig("hash_k8", leaf_k=8, max_degree=16, mode="hash"),
    SweepConfig("hash_k12", leaf_k=12, max_degree=16, mode="hash"),
]
