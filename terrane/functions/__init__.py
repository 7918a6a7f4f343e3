"""Part of the terrane engine."""
