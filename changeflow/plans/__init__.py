"""Plans: fixtures derived from the driver tables, registered queries and their SQL oracles."""
