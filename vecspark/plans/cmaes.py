"""Covariance matrix adaptation (Hansen's tutorial form), state on the driver.

Above FULL_LIMIT variables only the diagonal is kept (separable form, Ros and Hansen 2008).
"""

from __future__ import annotations

import math

import numpy as np

FULL_LIMIT = 1500


class CMAES:
    def __init__(self, mean: np.ndarray, sigma: float, population: int = 0, seed: int = 42):
        n = len(mean)
        self.mean, self.sigma, self.n = np.asarray(mean, float).copy(), sigma, n
        self.population = population or 4 + math.floor(3 * math.log(n))
        self.parents = self.population // 2
        raw = math.log((self.population + 1) / 2) - np.log(np.arange(1, self.parents + 1))
        self.weights = raw / raw.sum()
        self.mu_eff = 1 / (self.weights**2).sum()
        self.c_path = (4 + self.mu_eff / n) / (n + 4 + 2 * self.mu_eff / n)
        self.c_sigma = (self.mu_eff + 2) / (n + self.mu_eff + 5)
        self.c_one = 2 / ((n + 1.3) ** 2 + self.mu_eff)
        self.c_mu = min(1 - self.c_one, 2 * (self.mu_eff - 2 + 1 / self.mu_eff) / ((n + 2) ** 2 + self.mu_eff))
        self.diagonal = n > FULL_LIMIT
        if self.diagonal:  # the separable form may learn faster
            self.c_one, self.c_mu = self.c_one * (n + 2) / 3, min(1 - self.c_one * (n + 2) / 3, self.c_mu * (n + 2) / 3)
        self.damping = 1 + 2 * max(0.0, math.sqrt((self.mu_eff - 1) / (n + 1)) - 1) + self.c_sigma
        self.expected = math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        self.path, self.path_sigma = np.zeros(n), np.zeros(n)
        self.cov = np.ones(n) if self.diagonal else np.eye(n)
        self.basis, self.scale = (None if self.diagonal else np.eye(n)), np.ones(n)
        self.generation, self.best, self.best_fitness = 0, self.mean.copy(), np.inf
        self.rng = np.random.default_rng(seed)

    def _turn(self, z: np.ndarray) -> np.ndarray:
        return z * self.scale if self.diagonal else (z * self.scale) @ self.basis.T

    def _unturn(self, y: np.ndarray) -> np.ndarray:
        return y / self.scale if self.diagonal else self.basis @ ((self.basis.T @ y) / self.scale)

    def ask(self) -> np.ndarray:
        return self.mean + self.sigma * self._turn(self.rng.standard_normal((self.population, self.n)))

    def tell(self, solutions: np.ndarray, fitness: np.ndarray) -> None:
        """Lower is better."""
        order = np.argsort(fitness, kind="stable")
        if fitness[order[0]] < self.best_fitness:
            self.best, self.best_fitness = solutions[order[0]].copy(), float(fitness[order[0]])
        steps = (solutions[order[: self.parents]] - self.mean) / self.sigma
        move = self.weights @ steps
        self.mean = self.mean + self.sigma * move
        self.path_sigma = (1 - self.c_sigma) * self.path_sigma + math.sqrt(self.c_sigma * (2 - self.c_sigma) * self.mu_eff) * self._unturn(move)
        length = float(np.linalg.norm(self.path_sigma))
        early = math.sqrt(1 - (1 - self.c_sigma) ** (2 * (self.generation + 1)))
        steady = length / early < (1.4 + 2 / (self.n + 1)) * self.expected
        self.path = (1 - self.c_path) * self.path + steady * math.sqrt(self.c_path * (2 - self.c_path) * self.mu_eff) * move
        kept = 1 - self.c_one * (1 - (not steady) * self.c_path * (2 - self.c_path)) - self.c_mu
        if self.diagonal:
            self.cov = kept * self.cov + self.c_one * self.path**2 + self.c_mu * (self.weights @ steps**2)
            self.scale = np.sqrt(np.maximum(self.cov, 1e-20))
        else:
            self.cov = kept * self.cov + self.c_one * np.outer(self.path, self.path) + self.c_mu * (steps.T * self.weights) @ steps
            values, self.basis = np.linalg.eigh((self.cov + self.cov.T) / 2)
            self.scale = np.sqrt(np.maximum(values, 1e-20))
        self.sigma *= math.exp(self.c_sigma / self.damping * (length / self.expected - 1))
        self.generation += 1
