
import math

PHI = (1 + math.sqrt(5)) / 2
GOLDEN_ANGLE = 2.399963229728653
KB_EV = 8.617e-5
BLOCK = 8
COSINE_ZERO = 1e-9
NORM_ZERO = 1e-10
WEIGHT_ZERO = 1e-10
RANGE_ZERO = 1.1920929e-07
RANK_ZERO = 1e-9
NOISE_ZERO = 1e-12
