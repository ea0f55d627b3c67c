"""From a contract and a schema to one ordered list of planned checks over shared aggregate slots."""
