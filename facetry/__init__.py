"""Spark-native analytics over labelled graphs, descriptors and surface meshes.

Every public operator takes DataFrames and returns DataFrames, so operators chain with
``df.transform``.  Sub-packages:

``sources``    readers and writers for mesh, adjacency, label and descriptor text
``functions``  column expressions (vectors, angles, scalar shaping)
``operators``  relational operators (statistics, votes, graphs, energies, boosting, meshes)
``plans``      end-to-end jobs and the catalogue of named queries
"""
