"""Dossier: Spark-native compliance analytics over extracted document facts."""
