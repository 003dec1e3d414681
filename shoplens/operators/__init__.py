"""shoplens.operators"""
