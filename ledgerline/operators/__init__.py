"""DataFrame operators: sales rollup, input checks, name resolution, run history,
summary flattening."""
